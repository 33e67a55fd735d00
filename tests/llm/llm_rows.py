"""Rows shared by the tests of this folder."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empties, ties, repeated rows, white space and non-Latin text.
ODD_ROWS = [(None, None), (None, "one two three four five six"), (0, None), (1, ""), (2, " \n\t "), (3, "a"), (3, "a"), (4, "a b"),
            (5, "naïve café été 😀 日本語 and more words here"), (6, "naïve café été 😀 日本語 and more words here"),
            (7, "word " * 3000), (8, "word " * 3000), (8, "another text of the same id"), (9, "<|endoftext|> and 'll 've"),
            (10, "x" * 5000)]
