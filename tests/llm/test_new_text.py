"""Prefix trie, SentencePiece encoding and filter audit against brute force."""

import hashlib
import math
import random
import struct
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from voucherlens.llm import filter_audit, prefix_trie, sentencepieces
from voucherlens.llm.queries import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")


# --- trie --------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    """Conversations from the rows of a table, as the contract tells them."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def digest(t):
        said = f"{len(t[2])}:{t[2]}{t[3]}"
        return hashlib.sha256(said.encode()).digest()[:16]

    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:2], digest(t)))] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return built


def brute_trie(built):
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children.get(prefix, [])
        leaves[prefix] = sum(leaves[b] for b in below) or 1
        own = (len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        saved[prefix] = own + sum(saved[b] for b in below)
    return sorted(
        (
            min(ids), len(p), min(members[p[:-1]]) if p else -1, len(ids), len(children.get(p, [])), leaves[p], saved[p],
            sha(",".join(map(str, sorted(c for c in ids if len(built[c]) == len(p))))),
        )
        for p, ids in members.items()
    )


def conversations(spark, rows):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashes = ["depth", "high", "low", "block", "part", "place", "n", "member"]
    return made.withColumns({c: F.lit(i) for i, c in enumerate(clashes)})


def found_trie(blocks):
    rows = prefix_trie.trie(blocks).collect()
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in rows)


@pytest.fixture(scope="module")
def talks():
    """Families with shared first turns, NULLs, ties, repeats, one long conversation and its copy."""
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 24), *range(100, 112), 207, 209, 300, -5, -100, 10**12]:
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, ["user", "assistant"][t % 2], rng.choice(["hé", "yes", "no", "why", ""])))
    rows += [(0, None, None, "first"), (0, None, "user", None), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "user", "other")]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None), (5, None, None, None)]
    for c in (401, 402, 477, 499):
        rows += [(c, t, "user", f"turn {t % 7}") for t in range(300 if c < 477 else c - 349)]
    rows += [(c, t, "user", str(t % 3)) for c in (603, 600) for t in range(prefix_trie.BLOCK * 2)]
    rng.shuffle(rows)
    return rows


def test_trie_against_brute_force(spark, talks):
    expected = brute_trie(rebuilt(talks))
    assert found_trie(prefix_trie.rebuilt_turns(conversations(spark, talks))) == expected
    dealt = conversations(spark, talks).repartition(13)
    assert found_trie(prefix_trie.rebuilt_turns(dealt)) == expected


def test_plain_trie_and_deep_cuts(spark):
    """Depths of several blocks, with prefixes shared over cuts."""
    rows = [(c, t, "user", "x" if t < 130 * (c % 4) else f"{c % 9}") for c in range(12) for t in range(40 * c)]
    built = {}
    for c, _, role, text in rows:
        built.setdefault(c, []).append((role, text))
    assert found_trie(prefix_trie.plain_turns(conversations(spark, rows))) == brute_trie(built)


def test_trie_of_nothing(spark):
    assert found_trie(prefix_trie.rebuilt_turns(conversations(spark, []))) == []
    assert found_trie(prefix_trie.rebuilt_turns(conversations(spark, [(None, 1, "user", "x")]))) == []
    # All own turns are cut and the family's first conversation is absent: a turnless member.
    c = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert found_trie(prefix_trie.rebuilt_turns(conversations(spark, [(c, 0, "user", "x")]))) == [(c, 0, -1, 1, 0, 1, 0, sha(str(c)))]


# --- SentencePiece -----------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def odd_texts():
    rng = random.Random(6)
    letters = "aabceéß▁ \n\t\0 ☃😀thert.<s>|#漢字한‍﻿İǅ01"
    texts = ["", " ", "  ", "▁", "\n", "<s>", "<0x41>", "x" * 4000, " " * 4000, "ab " * 3000, "éa" * 5000, "a" * 50000]
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]


def test_ids_are_the_library_s(library):
    texts = odd_texts()
    found = [ids.tolist() for ids in sentencepieces.Encoder(PIECES).encode(texts)]
    assert found == library.encode(texts, add_bos=True, add_eos=True)


def test_full_caches_change_nothing(library, monkeypatch):
    for name, value in (("CACHED_SEGMENTS", 5), ("CACHED_PAIRS", 7), ("CACHED_BYTES", 4)):
        monkeypatch.setattr(sentencepieces, name, value)
    texts = odd_texts()[-400:]
    found = [ids.tolist() for ids in sentencepieces.Encoder(PIECES).encode(texts)]
    assert found == library.encode(texts, add_bos=True, add_eos=True)


def test_backtracking_goes_back():
    """The longest match first is not always right; places that failed are not tried again."""
    encoder = sentencepieces.Encoder(PIECES)
    texts = ["therererere", "ationsation", "ingssss", "aaaaaaaaaaaaa", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁x"]
    for text in texts:
        assert [encoder._said[t] for t in encoder.split(text)] == encoder.merged(text)


def test_encoding_a_table(spark, table, corpus, library):
    df = table(corpus)
    decoded = sentencepieces.decode(sentencepieces.encode(df, PIECES), PIECES)
    expected = []
    for doc, text in corpus:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        expected.append((doc, ids, library.decode(ids)))
    unpacked = lambda ids: list(struct.unpack(f"<{len(ids) // 4}I", ids))
    found = [(r["doc_id"], unpacked(r["ids"]), r["decoded"]) for r in decoded.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    digests = [
        (d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(said)) for d, ids, said in expected
    ]
    assert sorted(map(tuple, sentencepieces.digest(decoded).collect()), key=repr) == sorted(digests, key=repr)
    assert sentencepieces.encode(table([]), PIECES).collect() == []


# --- filter audit ------------------------------------------------------------


def brute_audit(rows, labels):
    """Every order applied to every document, one filter after the other."""
    import re

    def fails(doc, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [d for d, _, t in rows if (t or "") == text and d is not None]
        return {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": any(doc is None or i < doc for i in ids),
        }

    judged = [(d, p or "", fails(d, t or "")) for d, p, t in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out, shapley = [], {}
    for part in {p for _, p, _ in judged}:
        own = [(d, f) for d, p, f in judged if p == part]
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, name in enumerate(order, 1):
                removed = [(d, f) for d, f in left if f[name]]
                redundant = sum(f[name] for _, f in gone)
                left, gone = [x for x in left if not x[1][name]], gone + removed
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in own)
                shapley[part, name] = shapley.get((part, name), 0) + len(removed)
                out.append((part, "".join(order), step, len(left), len(removed), redundant, alone,
                            sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)))
    return sorted((*row, shapley[row[0], row[1][row[2] - 1]]) for row in out)


def audit_rows(corpus):
    rng = random.Random(2)
    rows = [(d, rng.choice(["a", "b", None, ""]), t) for d, t in corpus]
    rows += [(700 + i, "a", "SHOUTING words % " * 20) for i in range(5)]
    rows += [(720 + i, "b", " ".join(f"w{i}x{k}" for k in range(70))) for i in range(4)]
    rows += [(None, "b", "only without an id"), (None, "b", "only without an id"), (None, None, "SHOUTING words % " * 20)]
    return rows + [(702, "a", "SHOUTING words % " * 20)]  # a repeated row


def test_audit_against_brute_force(spark, corpus):
    rows = audit_rows(corpus)
    labels = [(d, i % 3 % 2, i % 5 % 2) for i, (d, _, _) in enumerate(rows)] + [(700, 1, None), (None, 1, 1), (99999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("part", "mask", "digest", "possible", "word", "n", "first_id")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(2))
    expected = brute_audit(rows, labels)
    for df in (docs, docs.repartition(9)):
        assert sorted(map(tuple, filter_audit.audit(df, marks).collect())) == expected
    empty = docs.limit(0)
    assert filter_audit.audit(empty, marks).collect() == []
    assert len(filter_audit.audit(docs, marks.limit(0)).collect()) == len(expected)


def test_sketch_lets_every_repeat_through(spark, monkeypatch):
    """Also when it is far too small; what it lets through besides is few when it is not."""
    texts = spark.range(4000).select(F.concat(F.lit("t"), F.when(F.col("id") < 40, F.col("id") % 20).otherwise(F.col("id"))).alias("text"))
    rows = texts.select("text", F.xxhash64("text").alias("digest"))
    for bits, most in ((filter_audit.cell_bits(4000), 300), (6, 4000)):
        words = filter_audit.crowded_cells(rows, "digest", bits)
        marked = filter_audit._with_possible(rows, "digest", words, bits)
        possible = {r["text"] for r in marked.where("possible").collect()}
        assert {f"t{i}" for i in range(20)} <= possible and len(possible) <= most


def test_orders_and_steps():
    rows = filter_audit.steps()
    assert len(rows) == 600 and len({r[0] for r in rows}) == 120
    assert ("CABED", 4, 16, 7) in rows
