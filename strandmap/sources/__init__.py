"""Sources and schema providers: CSV, IFC/STEP, ShEx, and paths."""
