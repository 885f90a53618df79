"""Rows that operators have to survive."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


#: Nulls, blanks, ties, repeated rows, one very long text.
ODD = [
    (None, None), (None, "a null id with a line of text\nand more"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (5, "one"), (6, "One two.\n\nOne two.\n"),
    (7, "word " * 60000), (8, "word " * 60000), (9, "ünï " * 50 + "\nline with enough letters"), (10, "x\nline with enough letters\ny"), (11, "\n\n\n"), (12, "line with enough letters"),
]
