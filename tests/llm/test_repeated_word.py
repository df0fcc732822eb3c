"""A text of one word over and over: most sorting rounds of its bucket are empty."""

import pandas as pd

from skyloom.llm import substrings


def _spans():
    send = substrings._mapper(48, substrings.WINDOW, substrings.GRAM)
    sent = pd.concat(send(iter([pd.DataFrame({"missing": [0, 0], "doc_id": [1, 2], "h": [7, 8], "text": ["a " * 400, "a " * 300]})])))
    blocks = [[b for b in part["block"] if b[:4] != b"\0\0\0\0"] for _, part in sent.groupby("bucket")]
    return {tuple(s) for b in blocks if b for s in substrings.repeated_windows(b, substrings.WINDOW).tolist()}


def test_rounds_without_windows(monkeypatch):
    one_round = _spans()
    monkeypatch.setattr(substrings, "SORT_WINDOWS", 40)
    assert _spans() == one_round and one_round
