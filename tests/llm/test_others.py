import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_words import words_of

import __spark_entry__ as entry
from checks.compare import differences
from voucherlens.llm import chat, decontamination, licenses, lines, packing, quality, url_reputation
from voucherlens.llm.oracle import oracle_sql
from voucherlens.llm.queries import QUERIES, URL_RULES, tokenizer_path

WORD_BPE, BYTE_BPE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


# --- packing -----------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_every_length_and_fit(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
    patterns = packing.pack_histogram(counts, 64)
    packed = {}
    for runs, count in patterns:
        assert sum(n * k for n, k in runs) <= 64
        for n, k in runs:
            packed[n] = packed.get(n, 0) + k * count
    assert packed == counts


def test_new_packs_are_filled_before_the_next_one_opens():
    assert packing.pack_histogram({10: 1000}, 64) == [([(10, 6)], 166), ([(10, 4)], 1)]


def test_pieces_are_the_tokenizers_ids_and_lie_gapless(table, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    special = [(500, "a <|endoftext|> B <|ENDOFTEXT|> c<|startoftext|>d"), (501, "O'Neill's x... y?! Été. ½. “q”. á. ÷. \x1cz")]
    rows = corpus + special
    found = packing.pack(table(rows), WORD_BPE, 256).collect()
    expected = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        for start in range(0, len(ids), 256):
            part = np.array(ids[start : start + 256], "<u4")
            expected.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted((tuple(r[:5]) for r in found), key=repr) == sorted(expected, key=repr)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 256
    assert packing.pack(table([]), WORD_BPE).collect() == []


# --- lines -------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + row
        row, last = [row[0]], row[1:]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lines.distance(a, b) == edit_distance(a, b)


def meets(left, right):
    """Which pairs of normalised lines share a block, and have SimHashes and lengths that allow a link."""
    shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(lines.block_keys(left), lines.block_keys(right))]
    near, _ = lines._allowed(lines.nodes(left), lines.nodes(right))
    apart = (lines.fine_simhashes(left) ^ lines.fine_simhashes(right)).view(np.uint64)
    longest = np.array([max(len(a.decode()), len(b.decode())) for a, b in zip(left, right)])
    fine = np.bitwise_count(apart).sum(axis=1) <= np.minimum(lines.FINE_APART, 6 * longest // 10)
    return np.array(shared) & near & fine


def brute_lines(rows, *, alone=False):
    """All pairs of lines by edit similarity: of those that meet, or ``alone``."""
    first, place = {}, {}
    for doc, text in rows:
        doc = lines.LAST_ID if doc is None else doc
        for i, line in enumerate((text or "").encode().split(b"\n")):
            n = lines.normal(line)
            if len(n) >= lines.LEAST:
                first[n] = min(first.get(n, (doc, i)), (doc, i))
    all_ = sorted(first, key=lambda n: len(n.decode()))
    sizes = [len(n.decode()) for n in all_]
    root = list(range(len(all_)))
    # Held against the plain table of distances in test_edit_distance.
    for i in range(len(all_)):
        for j in range(i - 1, -1, -1):
            if 10 * sizes[j] < 9 * sizes[i]:
                break
            if root[i] != root[j] and (alone or meets([all_[i]], [all_[j]])[0]) and lines.similar(all_[i].decode(), all_[j].decode()):
                root = [root[j] if r == root[i] else r for r in root]
    for i, n in enumerate(all_):
        place[root[i]] = min(place.get(root[i], first[n]), first[n])
    keep = {n: place[root[i]] for i, n in enumerate(all_)}
    out = []
    for doc, text in rows:
        d = lines.LAST_ID if doc is None else doc
        kept = [x for i, x in enumerate((text or "").encode().split(b"\n"))
                if keep.get(lines.normal(x), (d, i)) == (d, i)]
        out.append((doc, None if text is None else b"\n".join(kept).decode()))
    return sorted(out, key=repr)


def test_lines_against_brute_force(table, corpus):
    long = "every one of the many words in this rather long line is the same but for a single one namely "
    rows = corpus + [(600 + i, f"{long * 2} number {i} {long} {w}\nNo. {i}") for i, w in enumerate(["tree", "trees", "house"])]
    df = table(rows)
    built, columns = lines.dedup_lines(df)
    kept = built.select(*columns)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == brute_lines(rows)
    assert {tuple(r) for r in kept.select("key", "row", "lines").distinct().collect()} == {(0, 3, 9)}
    assert lines.dedup_lines(table([]))[0].collect() == []


def test_candidates_reach_nine_tenths_of_similar_lines():
    """Judged by edit similarity alone, over lengths and numbers of edits up to a tenth."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    pairs = []
    while len(pairs) < 1500:
        a = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))
        b = list(a)
        for _ in range(rng.randint(1, len(a) // 10)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "x"])
        b = " ".join("".join(b).split())
        if a != b and min(len(a), len(b)) >= lines.LEAST and lines.similar(a, b):
            pairs.append((a.encode(), b.encode()))
    left, right = map(list, zip(*pairs))
    met = meets(left, right)
    assert met.mean() >= 0.95
    heavy = np.array([10 * edit_distance(a, b) >= 0.8 * max(len(a), len(b)) for a, b in zip(left, right)])
    assert heavy.sum() > 50 and met[heavy].mean() >= 0.9


def test_pairs_in_one_table():
    rng = random.Random(10)
    left = ["".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 5, 30, 90]))) for _ in range(700)] + ["ab" * 1500, "é" * 2500]
    right = []
    for a in left:
        b = list(a)
        for _ in range(rng.randint(0, 1 + len(a) // 7)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yy"])
        right.append("".join(b))
    found = lines.similar_pairs(left, right)
    assert found.tolist() == [lines.similar(a, b) for a, b in zip(left, right)] and 100 < found.sum() < 650
    short = [i for i, a in enumerate(left) if len(a) < 100]
    assert [bool(found[i]) for i in short] == [
        10 * edit_distance(left[i], right[i]) <= max(len(left[i]), len(right[i])) for i in short
    ]


def families(seed=11):
    """Large groups of near copies with their own words, lines that share a long beginning only, and chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8)))
    rows, start = [], " ".join(word() for _ in range(12))
    for base in [" ".join(word() for _ in range(25)) for _ in range(3)]:
        for _ in range(90):
            copy = base.split()
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(25)] = word()
            rows.append(" ".join(copy))
    rows += [f"{start} {' '.join(word() for _ in range(12))}" for _ in range(150)]
    chain = [word() for _ in range(40)]
    for i in range(20):
        chain[2 * i] = word()
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_pairs_of_any_length_in_words_of_bits():
    """Bands of one word and of several, texts of very different lengths at once, and edits around the limit."""
    rng, left, right = random.Random(12), [], []
    for _ in range(900):
        size = int(10 ** rng.uniform(0, 3.2))
        a = "".join(rng.choice("abc é") for _ in range(size))
        b = list(a)
        for _ in range(int(size * rng.choice([0, 0.05, 0.09, 0.1, 0.11, 0.15]))):
            at = rng.randrange(size)
            b[at : at + 1] = rng.choice(["", b[at] + "x", "y", "b"]) if at < len(b) else ""
        cut = rng.randint(0, size // 10)
        left.append(a)
        right.append("".join(b[rng.choice([0, cut]) :]))
    left, right = map(list, zip(*[p if rng.random() < 0.5 else p[::-1] for p in zip(left, right)]))
    found = lines.similar_pairs(left, right)
    assert found.tolist() == [lines.similar(a, b) for a, b in zip(left, right)]
    assert 200 < found.sum() < 700


def test_pairs_are_checked_in_as_many_tasks_as_set(spark):
    """A pair is few bytes and much work, so tasks are not put together by their bytes."""
    said = [lines.normal(f"{'one two three four five six ' * 3}{w}".encode()) for w in ("seven", "eight", "ninety", "fifty")]
    keys = [lines.line_key(x) for x in said]
    texts = spark.createDataFrame([(k, x, n) for n, (k, x) in enumerate(zip(keys, said))], "key long, normal binary, node long")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)], "a long, b long")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        links = lines._links(pairs, texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    expected = {frozenset((keys[a], keys[b])) for a in range(4) for b in range(a) if lines.similar(said[a].decode(), said[b].decode())}
    assert {frozenset(r) for r in links.collect()} == expected
    assert len(links.inputFiles()) > 1


def test_large_groups_are_compared_in_full(table):
    rows = families()
    kept = lines.dedup_lines(table(rows))[0].select("row.doc_id", "text")
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == brute_lines(rows)


def test_counts_keep_every_similar_pair_and_few_chance_ones():
    """Character counts lose no similar pair, and lines that share a run by chance are not compared."""
    rng = random.Random(8)
    letters = "etaoinshrdluéß 日本"
    left, right = [], []
    for i in range(1500):
        line = "".join(rng.choice(letters) for _ in range(rng.randint(20, 400)))
        other = list(line)
        for _ in range(rng.randint(0, len(line) // 10)):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "yz"])
        left.append(lines.normal(line.encode()))
        right.append(lines.normal("".join(other).encode()))
    # Lines of other words around one run that both hold.
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    say = lambda: " ".join(rng.choice(words) for _ in range(6))
    chance = [(f"{say()} a run that is shared {say()}".encode(), f"{say()} a run that is shared {say()}".encode()) for _ in range(500)]

    def near(x, y):
        both = x + y
        node, none = lines.nodes(both), np.zeros(len(both), np.int64)
        columns = np.hstack([lines.fine_simhashes(both), lines.character_counts(both)]).T
        columns[: len(lines.FINE)] = 0  # by counts alone
        i, _, _ = lines.Sketches(node, none, columns).near(np.arange(len(x)), np.arange(len(x), len(both)))
        return set(i.tolist())

    similar = {i for i, (x, y) in enumerate(zip(left, right)) if lines.similar(x.decode(), y.decode())}
    assert len(similar) > 800 and similar <= near(left, right)
    assert len(near(*map(list, zip(*chance)))) < 50


def test_a_turn_gives_each_line_one_partner_a_block():
    """A block of many lines that are near and not connected gives no square of pairs, but the last turn all."""
    rng = random.Random(9)
    base = [rng.choice("etaoinshrdlu ") for _ in range(300)]
    texts = set()
    while len(texts) < 200:
        line = list(base)
        for _ in range(3):
            line[rng.randrange(300)] = rng.choice("etaoinshrdlu")
        texts.add("".join(line).encode())
    found = {n: t for t, n in zip(sorted(texts), lines.nodes(sorted(texts)).tolist())}
    node, said = np.array(list(found), np.int64), list(found.values())
    sketches = np.hstack([lines.fine_simhashes(said), lines.character_counts(said)]).T
    columns = dict(zip(lines.FINE + lines.COUNTS, sketches))
    for blocks in (1, 3):  # every line is a group of its own
        batches = [
            pa.RecordBatch.from_pydict({"block": np.full(len(node), k), "node": node, "group": node, "many": np.zeros(len(node), np.int64), **columns})
            for k in range(blocks)
        ]
        turn, left = (
            [p for b in lines._meet_again(t)(iter(batches)) for p in zip(*b.to_pydict().values())] for t in (0, None)
        )
        assert len(set(left)) > 10 * len(node) and set(turn) <= set(left)
        assert len(turn) <= blocks * len(node) and {n for p in turn for n in p} == {n for p in left for n in p}
        assert blocks == 1 or len(set(turn)) > 1.5 * len(node)  # others in each block


def test_pairs_left_are_checked_in_one_block_and_only_links_leave(monkeypatch):
    """Lines around one long passage meet in many blocks without being similar; each pair is compared once."""
    rng = random.Random(10)
    say = lambda n: "".join(rng.choice("etaoinshrdlu ") for _ in range(n))
    passage, buckets = say(260), 16
    texts = {lines.normal(f"{say(rng.randint(10, 45))}{passage}{say(20)}".encode()) for _ in range(150)}
    texts |= {x[:40] + b"zz" + x[42:] for x in sorted(texts)[:30]}
    said = sorted(texts)
    node, keys = lines.nodes(said), lines.block_keys(said)
    # Two lines of one node, without sketches of its own.
    node[1] = node[0]
    many = np.isin(node, node[:1]).astype(np.int64)
    sketches = np.hstack([lines.fine_simhashes(said), lines.character_counts(said)]).T
    in_block = {}
    for line, own in enumerate(keys):
        bucket, within = lines._block_of(lines._unpacked(lines._packed(own)), buckets)
        for block in set((bucket << 32 | within).tolist()):
            for other in np.flatnonzero(node == node[line]).tolist():  # a block holds all lines of a node
                in_block.setdefault(block, set()).add(other)
    batches, pairs = [], []
    for block in sorted(in_block):
        at = np.array(sorted(in_block[block]))
        columns = dict(zip(lines.FINE + lines.COUNTS, sketches[:, at]))
        batches.append(pa.RecordBatch.from_pydict({
            "block": np.full(len(at), block), "node": node[at], "group": at, "key": at, "many": many[at], **columns,
            "normal": pa.array([said[i] for i in at], pa.binary()),
        }))
        order = at[np.argsort(node[at], kind="stable")]
        x, y = np.triu_indices(len(at), 1)
        near, _ = lines._allowed(node[order][x], node[order][y])
        i, j, _ = lines.Sketches(node[order], many[order], sketches[:, order]).near(x[near], y[near])
        pairs += [tuple(sorted(p)) for p in zip(order[i].tolist(), order[j].tolist()) if node[p[0]] != node[p[1]]]
    compared, plain = [], lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda a, b: (compared.append(len(a)), plain(a, b))[1])
    found = [tuple(sorted(p)) for b in lines._check_left(buckets)(iter(batches)) for p in zip(*b.to_pydict().values())]
    assert len(pairs) > 5 * len(set(pairs)) and sum(compared) == len(set(pairs))
    similar = {p for p in set(pairs) if lines.similar(said[p[0]].decode(), said[p[1]].decode())}
    assert sorted(found) == sorted(similar) and 10 < len(found) < len(set(pairs)) // 2


def test_lines_do_not_depend_on_partitions(spark, table, corpus):
    rows = corpus + [(1000 + d, t) for d, t in families()]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in (1, 8, 211):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        kept = lines.dedup_lines(table(rows).repartition(parts))[0].select("row.doc_id", "text", "n_removed")
        found.append(sorted(map(tuple, kept.collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1] == found[2]


def test_documents_keep_what_edit_similarity_alone_keeps(spark, table, small):
    """Nine tenths of the lines that all pairs, judged by edit similarity alone, would remove."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()][:60]
    docs += [(5000 + d, t) for d, t in families(12)[:200]]
    count = lambda kept: sum(len((t or "").split("\n")) if t else 0 for _, t in kept)
    before, alone = count(docs), count(brute_lines(docs, alone=True))
    ours = count([(r["doc_id"], r["text"]) for r in lines.dedup_lines(table(docs))[0].select("row.doc_id", "text").collect()])
    assert before - ours >= 0.9 * (before - alone) and ours >= alone


def test_one_changed_character_is_a_copy(table):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklmno ") for _ in range(12 + 3 * i)) + " closing words" for i in range(40)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(100 + i, x[:8] + "z" + x[9:]) for i, x in enumerate(texts)]
    removed = {r["row"]["doc_id"]: r["n_removed"] for r in lines.dedup_lines(table(rows))[0].collect()}
    assert sum(removed[100 + i] for i in range(40)) >= 38 and not any(removed[i] for i in range(40))


# --- decontamination ---------------------------------------------------------


def brute_hits(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, text in items:
        w = words_of(text, pattern)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words_of(text, pattern), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [decontamination.BLOCK, 40])
def test_hits_against_brute_force(spark, table, corpus, block):
    items = [(i, " ".join((corpus[4 * i][1] or "").split()[5:40])) for i in range(8)]
    items += [(90, "One two"), (91, "x"), (92, None), (93, " ?! "), (94, items[0][1]), (95, "nowhere to be seen")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    found = decontamination.decontaminate(table(corpus), benchmark, block=block)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_hits(corpus, items)


def test_nothing_to_find(spark, table):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontamination.decontaminate(table([(1, "a b")]), empty).collect()] == [(1, 2, 0, [])]
    assert decontamination.decontaminate(table([]), empty).collect() == []


# --- chat --------------------------------------------------------------------

TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|x|>", "<\\\\|", "<|im_sep|>", "\n a", "é😀 <|endoftext|>", "", "<", "|>", "a <"]


@pytest.mark.parametrize("text", TRICKY)
def test_escape_is_reversible_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


def test_conversations_are_read_back(spark):
    rows = [(c, t, "assistant" if (t + c) % 2 else "user", TRICKY[(3 * c + t) % len(TRICKY)]) for c in range(12) for t in range(c + 1)]
    rows += [(50, None, "user", None), (50, 1, None, "x"), (50, 1, "assistant", "y"), (50, 1, "assistant", "y"), (None, 0, "assistant", "z")]
    rows += [(60, 0, "user", "hi"), (60, 1, "assistant", "long text " * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    found = chat.read_back(chat.format_conversations(df, BYTE_BPE)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else 99, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        content = "".join(f"{r}\n{x}\n" for _, r, x in own)
        expected.append((conv, len(own), sha(content), len(loss), sha(loss)))
    assert sorted((tuple(r[:5]) for r in found), key=repr) == sorted(expected, key=repr)
    assert chat.format_conversations(df.limit(0), BYTE_BPE).collect() == []


def test_mask_by_binary_search():
    start, end = np.array([0, 2, 4, 4, 6, 9]), np.array([2, 4, 4, 6, 9, 12])
    assert chat.loss_mask([(2, 6), (10, 12)], start, end).tolist() == [0, 1, 0, 1, 0, 1]
    assert chat.loss_mask([], start, end).tolist() == [0] * 6


# --- urls and licences ---------------------------------------------------------


def test_rules_and_hosts(spark):
    urls = ["https://A.Example.org/es/x?q", "http://example.org/en/12", "http://org/en", "https://x.com/de/", "x.com/fr/",
            None, "", "http://evil.com?/fr/", "ftp://b.co.uk/fr/#z", "http://notexample.org/es/", "http://a.com/fr/://b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = url_reputation.rule_outcomes(pages, URL_RULES)
    found = {r["page_id"]: r[1:5] for r in url_reputation.judge(pages, outcomes, URL_RULES).collect()}
    assert found[0][:] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[1][2:] == ("example.org/en/1", "block") and found[2][2:] == ("org/", "allow")
    assert found[3][2:] == ("com/de/", "block") and found[4] == ("", "", None, "allow")
    assert found[5] == found[6] == ("", "", None, "allow")
    assert found[7][:3] == ("evil.com", "", None) and found[8][:3] == ("b.co.uk", "/fr/", None)
    assert found[9][2:] == ("org/", "allow") and found[10][:3] == ("a.com", "/fr/://b", "com/fr/")
    assert url_reputation.judge(pages.limit(0), outcomes.limit(0), URL_RULES).collect() == []


def test_bad_hosts_are_blocked_and_small_ones_shrink(spark):
    outcomes = [("bad.com", 0)] * 40 + [(f"good{i}.com", 1) for i in range(60) for _ in range(5)] + [("once.com", 0), ("null.com", None)]
    pages = [(1, "http://bad.com/x"), (2, "http://once.com/x"), (3, "http://good1.com/"), (4, "http://new.com/"), (5, "http://null.com/")]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame(outcomes, "host string, good int")
    found = {r["page_id"]: r["verdict"] for r in url_reputation.judge(pages, outcomes, []).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}


def test_hosts_without_outcomes_take_their_domain_suffix_or_all_pages(spark):
    outcomes = [(f"h{i}.bad.com", 0) for i in range(8) for _ in range(20)]
    outcomes += [(f"good{i}.com", 1) for i in range(60) for _ in range(5)]
    outcomes += [(f"d{i}.xyz", 0) for i in range(30) for _ in range(5)]
    urls = {1: "new.bad.com", 2: "new.good1.com", 3: "other.com", 4: "new.xyz", 5: "new.net"}
    pages = spark.createDataFrame([(k, f"http://{h}/") for k, h in urls.items()], "page_id long, url string")
    outcomes = spark.createDataFrame(outcomes, "host string, good int")
    found = {r["page_id"]: r for r in url_reputation.judge(pages, outcomes, []).collect()}
    assert {k: r["verdict"] for k, r in found.items()} == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}
    assert all(r["good_share"] is not None for r in found.values())
    bad = spark.createDataFrame([(f"h{i}.com", 0) for i in range(200)], "host string, good int")
    assert {r["verdict"] for r in url_reputation.judge(pages, bad, []).collect()} == {"block"}


def test_licences(table):
    grant = licenses.SENTENCES["mit-grant"] + "\n" + licenses.SENTENCES["mit-condition"]
    rows = [(1, "Text. Licensed under the  APACHE license, version 2.0. More"), (2, grant.upper()), (3, licenses.SENTENCES["mit-condition"]),
            (4, None), (5, ""), (6, "Licensed under CC BY 4.0.\nreleased under the MIT License"), (7, "x. " * 5000 + "All rights reserved.")]
    found = {r["doc_id"]: r["licences"] for r in licenses.scan(table(rows)).collect()}
    assert found == {1: ["Apache-2.0"], 2: ["MIT"], 3: [], 4: [], 5: [], 6: ["CC-BY-4.0", "MIT"], 7: ["proprietary"]}
    assert licenses.scan(table([])).collect() == []


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twins(spark, small, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    assert differences(QUERIES[name](spark, small).toPandas(), connection.execute(oracle_sql()[name]).df()) == []


# --- quality -----------------------------------------------------------------


def test_coordinate_descent_comes_near_the_optimum(monkeypatch):
    """The primal objective after the usual epochs against that after very many."""
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(0, 30, 8)) for _ in range(120)]
    signs = np.array([1 if (t < 15).mean() > 0.5 else -1 for t in texts])
    ratios = np.linspace(2, -2, 30)

    def objective(model):
        fitted = [i for i in range(len(texts)) if i % quality.CALIBRATE_EVERY != quality.CALIBRATE_EVERY - 1]
        drawn = (signs[fitted] > 0).mean()
        cost = quality.COST * np.where(signs > 0, 0.5 / drawn, 0.5 / (1 - drawn))
        loss = sum(cost[i] * max(0, 1 - signs[i] * model.margin(texts[i])) for i in fitted)
        return 0.5 * (((model.weighted / ratios) ** 2).sum() + model.intercept**2) + loss

    usual = quality.fit_margin(texts, signs, ratios, 0.5)
    monkeypatch.setattr(quality, "EPOCHS", 500)
    assert objective(usual) <= 1.03 * objective(quality.fit_margin(texts, signs, ratios, 0.5))
    margins = np.array([usual.margin(t) for t in texts])
    scores = usual.score(margins)
    assert ((margins > 0) == (signs > 0)).mean() > 0.8 and scores.min() >= 0 and scores.max() <= 1
    assert (np.argsort(scores, kind="stable") == np.argsort(margins, kind="stable")).all()


def test_held_out_accuracy_and_edge_cases(spark, small, table):
    small = small.replace("sf0.001", "sf0.01")  # enough labels to learn from
    documents = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    found = QUERIES["op9_quality_classifier"](spark, small).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found]) >= 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    model = quality.fit(documents, labels)
    odd = quality.score(table([(1, None), (2, ""), (3, "a"), (None, "b c" * 9000), (1, None)]), model).collect()
    assert len(odd) == 5 and all(0 <= r["score"] <= 1 for r in odd)
    assert odd[0]["score"] == odd[1]["score"]
    assert quality.score(table([]), model).collect() == []
    nothing = quality.fit(documents, labels.limit(0))
    assert {r["score"] for r in quality.score(table([(1, "x")]), nothing).collect()} == {0.5}


# --- registration and pipeline -------------------------------------------------


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert json.dumps(sorted(oracle_sql()))
