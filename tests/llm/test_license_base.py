"""The base phrases of the license scan, against the words of its contract."""

from __future__ import annotations

from corpuswright.llm import licenses


def test_the_gnu_phrase_counts_with_its_first_word_only():
    assert licenses.scan("the General Public License, version 2")[:5] == (6, 0, None, None, "")
    assert licenses.scan("under the GNU General\nPublic-License; a general public license")[:5] == (10, 1, 2, 2, "gpl")
    assert licenses.scan("gnu gnu general public license")[:5] == (5, 1, 1, 1, "gpl")
