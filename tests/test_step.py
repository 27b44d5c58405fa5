"""STEP files: comments, strings, cut-off files, and the time that reading takes."""

import random
import time

import pytest

from strandmap.errors import ParseFault
from strandmap.sources import step


def ids(text, kind="IFCWALL"):
    return [i for i, _ in step.entities(text, kind)]


def test_comments_hide_what_they_hold_and_nothing_else():
    assert ids("#9=IFCSLAB(1)/* don't */;\n#1=IFCWALL('g');") == [1]
    assert ids("/* #1=IFCWALL('g'); */#2=IFCWALL('h');/* ' */ #3 /* a */ = /* b */ IFCWALL /* ( */ ('i' /* , */ , $);") == [2, 3]
    assert ids("#1=IFCLABEL('/* '); #2=IFCWALL(''' */ #7=IFCWALL()');#3=IFCWALL('');/* open #4=IFCWALL('');") == [2, 3]
    assert [v for _, v in step.entities("#2=IfcWall(''' */','a''b');", "IFCWALL")] == [("' */", "a'b")]


def test_references_and_names_are_no_entities():
    assert ids("#1=IFCX(#2,#3); #22=IFCWALLTYPE($); #4=(IFCWALL($) IFCY($)); #5=IFCWALL(#1,(#2,#3),IFCLABEL('x'),.T.,*,1.5E-3);") == [5]


def test_cut_off_files():
    whole = "#1=IFCWALL('g',$);#2=IFCSLAB('" + "a''b " * 50 + "');#3=IFCWALL('h');"
    for n in range(len(whole)):
        try:
            assert ids(whole[:n]) in ([], [1]) or n == len(whole) - 1  # all but the last sign
        except ParseFault:
            assert whole[:n].rfind("IFCWALL(") > whole[:n].rfind(";")
    assert ids(whole) == [1, 3]


HOSTILE = {"empty strings": "#1=IFCSLAB(" + "''," * 100_000, "odd strings": "#1=IFCSLAB(" + "'''," * 100_001, "comments": "/*" * 200_000, "blanks": "#1" + " " * 200_000, "starts": "#1 = IFCSLAB" * 50_000, "commented": "#1/**/" * 50_000}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_reading_takes_time_in_proportion(name):
    began = time.process_time()
    assert ids(HOSTILE[name]) == []
    assert time.process_time() - began < 3


def test_entities_are_those_of_a_scan_by_characters():
    rng = random.Random(5)

    def plain(text):
        """Entities of IFCWALL whose start is outside of strings and comments."""
        out, i = [], 0
        while i < len(text):
            if text[i] == "'":
                j = text.find("'", i + 1)
                i = len(text) if j < 0 else j + 1
            elif text.startswith("/*", i):
                j = text.find("*/", i + 2)
                i = len(text) if j < 0 else j + 2
            elif text.startswith("#1=IFCWALL($)", i):
                out.append(i)
                i += len("#1=IFCWALL($)")
            else:
                i += 1
        return len(out)

    for _ in range(2000):
        text = "".join(rng.choice(["'", "/*", "*/", "#1=IFCWALL($)", ";", " ", "#2"]) for _ in range(rng.randrange(14)))
        assert len(ids(text)) == plain(text), text
