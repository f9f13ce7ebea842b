import numpy as np
import pyarrow as pa

from tests_words import words_of
from voucherlens.llm.text import NOT_ALNUM, SPACE, flat, shingle_sets, slices, word_hashes, words

TEXTS = ["Hello  World foo\nbar baz qux", "", None, "a b", "x", "ÀB c1-d2 ", "end", " lead", "\x1c\x85a\x0bb", "A b", "\x00"]


def test_words_match_patterns():
    data, at = flat(pa.array(TEXTS))
    for separators, pattern in ((SPACE, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        start, end, before = words(data, at, separators)
        folded = data.tobytes().lower()
        found = [folded[a:b].decode() for a, b in zip(start, end)]
        expected = [words_of(t, pattern) for t in TEXTS]
        assert found == [w for own in expected for w in own]
        assert np.diff(before).tolist() == [len(own) for own in expected]


def test_equal_words_have_equal_hashes_anywhere():
    data, at = flat(pa.array(["Tree x tree", "y", "TREE"]))
    start, end, _ = words(data, at, SPACE)
    a, _, b, _, c = word_hashes(data, start, end).tolist()
    assert a == b == c and len(set(word_hashes(data, start, end).tolist())) == 3


def test_shingle_sets_count_distinct_runs():
    texts = ["a b c d e f a b c d e", "a b c", "A B C", "", None]
    data, at = flat(pa.array(texts))
    sets = shingle_sets(data, at, 5)
    expected = []
    for t in texts:
        w = words_of(t)
        expected.append(len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))
    assert [len(s) for s in sets] == expected
    assert sets[1].tolist() == sets[2].tolist()


def test_slices_cover_all_rows_and_keep_long_texts_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, "b" * 500, None, "c", "d" * 40]})
    parts = list(slices(iter([batch]), limit=50))
    assert [r.num_rows for r, _, _ in parts] == [1, 1, 2, 1] or sum(r.num_rows for r, _, _ in parts) == 5
    assert b"".join(d.tobytes() for _, d, _ in parts) == b"a" * 10 + b"b" * 500 + b"c" + b"d" * 40
