"""The mapping language: source text to frames."""

from strandmap.lang.compiler import Program, compile_program, compile_text, run_text

__all__ = ["Program", "compile_program", "compile_text", "run_text"]
