import re

import numpy as np
import pyarrow as pa

from packetloom.llm import words

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


TEXTS = ["One two, THREE", "", None, "tail", "head tail", "Élan ÉLAN élan", "x" * 600_000, "a b " * 9, "ünder-score_9 4.5"]


def test_words_are_those_of_the_pattern():
    got = words.words_of(TEXTS)
    for i, text in enumerate(TEXTS):
        assert [got.word(k) for k in range(got.first[i], got.first[i + 1])] == plain(text)


def test_hashes_depend_on_the_word_only():
    got = words.words_of(TEXTS)
    by_word = {}
    for k in range(len(got.hashes)):
        assert by_word.setdefault(got.word(k), got.hashes[k]) == got.hashes[k]
    assert len(set(by_word.values())) == len(by_word)
    alone = words.words_of(["tail"])
    assert alone.hashes[0] == by_word["tail"]
    sliced = words.words_of(pa.array(["skip me", "tail"], pa.string()).slice(1))
    assert sliced.hashes[0] == by_word["tail"]


def test_shingles():
    w = words.words_of(["a b c d e f", "a b c d e", "a b"])
    first = words.shingles(w.hashes[:6], 5)
    assert len(first) == 2 and first[0] == words.shingles(w.hashes[6:11], 5)[0]
    assert len(words.shingles(w.hashes[11:], 5)) == 1 and len(words.shingles(w.hashes[:0], 5)) == 0


def test_chunks_keep_all_rows():
    batch = pa.record_batch({"id": range(5), "text": ["aaaa", None, "b" * 50, "", "cc"]})
    out = list(words.chunks(iter([batch]), "text", 8))
    assert [x for b in out for x in b.column("id").to_pylist()] == list(range(5)) and len(out) > 1
    assert np.all([b.num_rows > 0 for b in out])
