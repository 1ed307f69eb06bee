"""Benchmark items of one word, which have no answer part."""

from sparkloom.llm import decontaminate


def test_one_word_item():
    index = decontaminate.build([(1, b"Zyzzyva"), (2, b"the quick brown fox jumps over a lazy dog"), (3, b" .. ")])
    found = decontaminate.search(index, [b"a zyzzyva, here", b"nothing here", b""])
    assert [[x["item_id"] for x in f] for f in found] == [[1], [], []]
