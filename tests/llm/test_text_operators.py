"""Every operator against a brute-force version, on whole texts with nulls, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mergeloom.llm import bpe, langid, linededup, lm, mixing, quality, rules, simhash, topk, toxicity
from mergeloom.llm import queries as registered

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Texts with shared lines, copies and near copies, nulls, blanks, a long text, and a repeated row."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "  The SAME Line, again and again: " + line(8) + "\t"
    texts = [None, "", " \t\n ", "one", "É à ß 你好", "word " * 9, "a b c d e " * 6, "x" * 5000]
    for i in range(40):
        parts = [line(rng.randint(3, 14)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), shared if i % 2 else shared.lower().strip())
        if i % 7 == 0:
            parts.append(parts[0])
        texts.append("\n".join(parts))
    texts += [texts[20], texts[20] + " end", texts[21].upper()]
    texts.append("\n".join(line(12) for _ in range(800)))
    rows = [(i * 7 % 101, t, ["en", "de", None][i % 3], ["a", "b", "a", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[15], rows[15], (None, "no id " + shared, None, None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    for clash in ("fp", "size", "kept", "batch", "weight", "key", "tile", "y", "words", "score", "component_id", "token_ids", "h1"):
        out = out.withColumn(clash, F.lit("own"))
    return out


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(0, 101, 2)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_sql(sql, tables):
    """Rows of a registered SQL over the tables, in DuckDB."""
    import duckdb

    with duckdb.connect() as db:
        for name, df in tables.items():
            db.register(name, df.toArrow())
        return db.sql(sql).fetchall()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(spark, docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for doc, text, *_ in corpus():
        for x in (text or "").split("\n"):
            if doc is not None and len(key(x)) >= 40:
                holders[key(x)].add(doc)
    often = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert often
    expected = []
    for r in corpus():
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if r[0] is None or not r[0] < often.get(key(x), -2)]
        expected.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = linededup.dedup_lines(docs)
    assert set(docs.columns) - {"kept"} < set(got.columns)
    rows = [(r.doc_id, r.n_lines, r.n_dropped, r["kept"]) for r in got.collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(rows) == order(expected)
    assert linededup.line_digest(empty(spark)).count() == 0
    # Many batches and compactions change nothing.
    for options in ({"batches": 7, "fanout": 2, "heavy_share": 2}, {"batches": 9, "fanout": 3, "heavy_share": 1}):
        again = linededup.dedup_lines(docs, **options)
        assert order([(r.doc_id, r.n_lines, r.n_dropped, r["kept"]) for r in again.collect()]) == order(expected)


def test_line_dedup_counts_doc_ids(spark):
    """One doc_id with several rows is one document, a row without is none; the registered SQL agrees."""
    long = "x" * 45
    few = [(1, long), (1, long), (1, f"a\n{long}"), (2, long), (3, long), (None, long), (None, long)]
    enough = [*few, (4, f"{long}\n{long}\nend"), (5, f" {long.upper()} "), (-(2**62), long), (2**62, long), (7, None)]
    for rows in (few, enough, []):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((tuple(r) for r in linededup.line_digest(df).collect()), key=str)
        assert got == sorted(by_sql(linededup.SQL, {"documents": df}), key=str)
        assert any(r[2] for r in got) == (rows is enough)


def test_runs_drop_what_is_settled(spark):
    """A batch adds only keys that the runs before it have not settled."""
    rows = lambda docs, keys: spark.createDataFrame([(k, -k, d) for d in docs for k in keys], "h1 long, h2 long, doc long")
    runs = linededup.LineRuns(spark, min_docs=2, buckets=3, fanout=2)
    held = lambda: sorted((r.h1, r.n_docs, r.keeper) for n in runs._runs() for r in spark.table(n).collect())
    assert runs.add(rows([9, 8], [1, 2]).union(rows([9], [3])), 3).count() == 2
    assert held() == [(1, 2, 9), (2, 2, 9), (3, 1, 9)]
    runs.add(rows([7], [1, 3, 4]), 1)
    assert held() == [(1, 2, 9), (2, 2, 9), (3, 2, 9), (4, 1, 7)] and [len(x) for x in runs.levels] == [0, 1]
    runs.add(rows([5], [2, 3, 4]), 1)
    assert sorted((r.h1, r.keeper) for r in runs.settled().collect()) == [(1, 9), (2, 9), (3, 9), (4, 7)]
    assert not runs._paths


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(corpus())
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for r in corpus():
        sizes[r[3]] += size(r[1])
    weight = {s: w for s, w in zip(["a", "b", None], [5, 2, 1])}
    target, free, rest = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:  # reshare the excess until no source is above its cap
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        free -= over
    target |= share
    taken = Counter()
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    largest = max(size(r[1]) for r in corpus())
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1 for s in sizes)
    order = lambda rows: sorted(str((r.doc_id, r.text, r.positions)) for r in rows)
    assert order(got) == order(mixing.mix_sources(docs.repartition(7)).collect())
    assert "weight" in mixing.mix_sources(docs).columns and mixing.mix_digest(empty(spark)).count() == 0
    mixed = [(r.position, r.doc_id) for r in mixing.curriculum(docs).collect()]
    assert [p for p, _ in mixed] == sorted(p for p, _ in mixed) and len(mixed) == sum(r.copies for r in got)
    # The digest is the curriculum: its first and last positions, in their order, and what they take.
    digest = mixing.mix_digest(docs).collect()
    first = [r.first_position for r in digest]
    assert first == sorted(first, key=lambda p: (p is None, p))
    assert Counter(p for p, _ in mixed) == Counter(p for r in got for p in r.positions)
    times = lambda r: 0 if r.first_position is None else 1 + (r.last_position > r.first_position)
    assert all(r.taken == times(r) * r.size for r in digest) and {p for p in first if p is not None} <= {p for p, _ in mixed}
    with pytest.raises(ValueError, match="no schedule"):
        mixing.mix_sources(docs, weights=(5, 3))


def test_mixing_by_sql(spark):
    """The registered SQL, on ids that are null or repeat with one text; sources that tie, one without words."""
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(7000, "one two", "a")] * 3 + [(7001, None, "empty"), (7002, " \n", "empty"), (7003, "x " * 4000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want = (sorted(map(tuple, x), key=str) for x in (mixing.mix_digest(df).collect(), by_sql(mixing.SQL, {"documents": df})))
    assert got == want


def test_schedule_inversion(spark):
    for shape in ([1.0, 1.0], [1.5, 1.0, 0.5], [0.2, 3.0, 1.0, 0.5]):
        grid = np.linspace(0, 1, 200001)
        weights = np.interp(grid, np.linspace(0, 1, len(shape)), shape)
        total = np.concatenate(([0], np.cumsum((weights[1:] + weights[:-1]) / 2)))
        df = spark.createDataFrame([(x / 20,) for x in range(21)], "share double")
        got = df.select("share", mixing.invert_schedule(F.array(*map(F.lit, shape)), F.col("share")).alias("t")).collect()
        for r in got:
            assert r.t == pytest.approx(np.interp(r.share, total / total[-1], grid), abs=1e-4)


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rows = corpus()
    prints = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    expected = sorted(str((r[0], f"{prints[i]:016x}", least.get(find(i)))) for i, r in enumerate(rows))
    got = simhash.near_components(docs).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == expected
    assert simhash.near_components(empty(spark)).count() == 0
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {least[find(i)] for i in range(len(rows)) if find(i) in least} | {
        r[0] for i, r in enumerate(rows) if find(i) not in least}


def test_tiles_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [b ^ np.uint64(1 << int(x) | 1 << int(y)) for b in base for x, y in rng.integers(0, 63, (12, 2))]
    prints = np.unique(np.concatenate((base, np.array(flips, np.uint64))))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    for _ in range(len(prints)):
        label = np.where(near, label[None, :], len(prints)).min(axis=1)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = simhash.near_links(df, 4, tiles=8, tile_rows=(16, 64)).collect()
    index = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    root = list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for r in links:
        assert label[index[r.u]] == label[index[r.v]]
        root[find(index[r.u])] = find(index[r.v])
    for i in range(len(prints)):
        for j in np.flatnonzero(label == label[i]):
            assert find(i) == find(int(j))


def test_bpe(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordTokenizer(path)
    library.no_truncation(), library.no_padding()
    rng = random.Random(3)
    odd = [chr(x) for x in range(0x250)] + list("ΣσςİıﬁÅ①½²٣४你好한국🎉👩🏽‍\u0085\x1c﻿") + ["<|endoftext|>", "<|startoftext|>", "<|", "'LL", "'s", "aaaa", "----"]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.5 else rng.choice("abcdethinsr ") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    vocab = [w.removesuffix("</w>") for w in library.get_vocab() if w.isascii() and w.endswith("</w>")][:8000]
    for text in texts + vocab:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for r in corpus():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected.append(str((r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))))
    got = bpe.bpe_digest(docs, path).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(expected)
    assert bpe.bpe_digest(empty(spark), path).count() == 0
    encoded = bpe.encode_documents(docs, path)
    assert set(encoded.columns) == set(docs.columns)
    back = bpe.decode_documents(encoded, path).select("token_ids", "decoded").collect()
    assert all(library.decode(r.token_ids, skip_special_tokens=False) == r.decoded for r in back)


def test_automaton_against_merging():
    """Random merge lists, equal parts included, against applying the merges one by one."""
    rng = random.Random(8)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("ab")}, []
        for _ in range(rng.randint(1, 8)):
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        automaton = bpe.TokenAutomaton(vocab, merges)
        for _ in range(40):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
            parts = list(word)
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (u, v):
                        parts[i : i + 2] = [u + v]
                    i += 1
            got = [automaton.label[t] for t in automaton._encode(word)]
            assert got == parts, (merges, word)


def brute_statistics(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, docs, labels):
    got = rules.quality_digest(docs, labels).collect()
    expected = []
    for r in corpus():
        s = brute_statistics(r[1])
        expected.append(str((r[0], *s, s[0] < 10 or 100 * s[4] > 20 * s[0])))
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(expected)
    assert not any(r.kept for r in got if r.base_failed)
    assert rules.quality_digest(empty(spark), labels).count() == 0
    assert str(rules.learn_quality_rules(docs, labels.limit(0))) == "keep"
    # A filter on a statistic must not repeat its expressions at each mention.
    assert rules.apply_rules(docs, rules.DecisionList(())).where("kept and n_words > 20 and n_repeat_words < 5").count() > 0


def test_decision_list_finds_a_planted_rule():
    rng = np.random.default_rng(4)
    x = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    found = rules.learn(x, bad)
    covered = np.zeros(900, bool)
    for rule in found.rules:
        covered |= rules._covered(list(rule), x)
    assert (covered & bad).sum() > 0.9 * bad.sum() and (covered & ~bad).sum() <= 0.02 * (~bad).sum()


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 24).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(5000, None), (5020, []), (5040, [None] * 24), (5060, [float("nan")] * 24), (5080, [float("inf")] * 24), (None, rows[0][1]), (6000, [1.0, 2.0])]
    rows += [(20, rows[20][1])] + [(21, rows[21][1])] * 30 + [(23, rows[24][1]), (40, rows[41][1])]  # repeated rows, and ids with two vectors
    df = spark.createDataFrame([(i, v, "own") for i, v in rows], "vec_id long, embedding array<float>, score string")
    sound = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    scores = defaultdict(list)
    for i, q in sound:
        if i % 20 == 0:
            scores[i] += [(-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i and len(v) == len(q)]
    expected = [(i, k, j, -s) for i in scores for k, (s, j) in enumerate(sorted(scores[i])[:20], 1)]
    for sizes in ({}, {"query_rows": 7, "block_rows": 50}):
        got = sorted(tuple(r) for r in topk.top_products(df, **sizes).collect())
        assert got == sorted(expected)
    assert topk.top_products(df.limit(0)).count() == 0
    # The registered SQL agrees on repeated rows and ids with several vectors.
    same = df.where("size(embedding) = 24 or embedding is null")
    assert sorted(tuple(r) for r in topk.top_products(same).collect()) == sorted(by_sql(topk.SQL, {"embeddings": same.drop("score")}))


def test_driver_lets_go_of_memory(spark, docs, monkeypatch):
    import public_tokenizers

    from mergeloom import runtime

    assert runtime.trim_driver(spark)  # by the JVM of these tests
    monkeypatch.setattr(bpe, "_loaded", {})
    monkeypatch.setattr(bpe, "_sent", {})
    sent = bpe._compiled(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert bpe._loaded == {} and bpe._compiled(docs, public_tokenizers.path("word_bpe_49k.json")) is sent
    trims = []
    monkeypatch.setattr(runtime, "trim_driver", lambda s: trims.append(s))
    runtime.forget(runtime.written(docs.limit(1), "one"))
    assert len(trims) == 1


SMALL = lm.Settings(slots_log2=12, page_log2=10, fan_in=2)


def test_lm(spark, docs):
    tokens = lambda t: [*WORD.findall((t or "").translate(LOW)), 0]
    part = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = Counter(t for r in corpus() if part(r[0]) != 2 for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    got = sorted(lm.score_documents(docs, SMALL).collect(), key=lambda r: str((r.doc_id, r.n_tokens)))
    expected = sorted(corpus(), key=lambda r: str((r[0], len(tokens(r[1])))))
    for r, e in zip(got, expected, strict=True):
        t = tokens(e[1])
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (e[0], part(e[0]) == 2, len(t), sum(counts[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) and r.score < 0
    assert lm.score_documents(empty(spark), SMALL).count() == 0


def test_lm_is_a_distribution():
    """Decisions are a prefix code, so the words' probabilities sum to one at most; the code is whole."""
    counts = np.array([50, 20, 7, 3, 2, 1, 1])
    codes, lengths = lm.huffman(counts)
    assert sum(2.0 ** -lengths) == 1 and len({format(c, f"0{n}b") for c, n in zip(codes, lengths)}) == len(counts)
    words = {format(c, f"0{n}b") for c, n in zip(codes, lengths)}
    assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_lm_last_two_frequent_words():
    """The fourth predictor tells texts apart that differ in the last frequent word but one."""
    raw = np.frombuffer(b"a b c" + b"c b c", np.uint8)
    hashes = lm.Texts(raw, np.array([0, 5, 10])).distinct()[0]
    code = lm.Code(np.append(hashes, [lm.END, lm.ESCAPE]), np.array([9, 8, 7, 2, 1]))
    slots = []
    for part in (raw[:5], raw[5:]):
        t = lm.Tokens(part, np.array([0, 5]), code, 1 << 40)
        slots.append(lm.decisions(t, 2, 3, code, 20)[0])
    assert slots[0].shape[0] == lm.CONTEXTS == 4
    assert (slots[0][:3] == slots[1][:3]).all() and (slots[0][3] != slots[1][3]).all()


def test_lm_grows_with_the_corpus(spark, docs, monkeypatch):
    """Tables hold two slots for each training word, however many; a share of texts fits the weights; ranges of slots add up."""
    assert [lm.sized(lm.Settings(), n).slots_log2 for n in (0, 1 << 20, 3_370_956, 1 << 30)] == [21, 21, 23, 31]
    assert lm.weight_rate(lm.Settings(), 100) == 0.5 and lm.weight_rate(lm.Settings(), 256_000_000) * 256_000_000 == 1_000_000
    seen, pages = [], lm.slot_pages
    monkeypatch.setattr(lm, "slot_pages", lambda texts, code, s: seen.append(s.slots_log2) or pages(texts, code, s))
    least = lm.Settings(slots_log2=4, page_log2=3, counted_log2=5, fan_in=2)
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score_documents(docs, least).collect()}
    part = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    words = len({w for r in corpus() if part(r[0]) != 2 for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")})
    assert len(seen) == 2 and seen[0] == seen[1] and 2 ** seen[0] >= words > 2**4
    whole = lm.Settings(slots_log2=seen[0], page_log2=3, fan_in=2)
    assert got == pytest.approx({(r.doc_id, r.n_tokens): r.score for r in lm.score_documents(docs, whole).collect()})


def test_lm_slots_count_beyond_16_bits():
    slots, bit = np.repeat(np.array([[5, 9, 6]]), [100_000, 40_000, 3], axis=1).repeat(lm.CONTEXTS, axis=0), np.arange(140_003) % 2
    counts = lm.Slots(4, 4)
    counts.add(slots, bit)
    page = counts.page(3, 0, 4)
    assert page.tolist() == [[0, 50_000, 1, 0], [0, 50_000, 2, 0]] or page.tolist() == [[0, 50_000, 2, 0], [0, 50_000, 1, 0]]
    assert (lm.unpacked(lm.packed(page), 8) == page.ravel()).all()


def test_lm_codes_every_frequent_word(spark):
    """No cap on the words that have codes."""
    n = (1 << 19) + 10
    counts = spark.range(1, n + 1).select(F.col("id").alias("word"), F.lit(6).cast("long").alias("c")).where(F.col("word") != int(lm.END))
    code = lm.vocabulary(counts, lm.Settings(), 6 * n, n)
    assert len(code.hashes) == n + 1 and (code.find(np.array([1, n], np.uint64)) >= 0).all()
    assert (2.0 ** -code.lengths.astype(float)).sum() == 1


M64 = 2**64 - 1


def scalar_mix(h):
    h = (h ^ (h >> 32)) * 0x9E3779B97F4A7C15 & M64
    return h ^ (h >> 29)


def scalar_decisions(text, code, slots_log2):
    """Plain Python: of each token of a text, (slots of all predictors, bit, kind) of each decision, one by one."""
    from mergeloom.llm import text as words

    names = [m.group().encode() for m in WORD.finditer(text.translate(LOW))]
    node = lambda x: (x * int(lm.NODE) & M64) >> 32
    slot = lambda n, c: ((n ^ c) * int(lm.HASH) & 0xFFFFFFFF) >> (32 - slots_log2)
    rolled = lambda b: scalar_mix(sum(int(words._BYTES[x]) * pow(words._BASE, i, 2**64) for i, x in enumerate(b)) & M64)
    symbols = {int(h): i for i, h in enumerate(code.hashes)}
    before, seen, out = 513, [], []
    for name in [*names, None]:
        symbol = code.end if name is None else symbols.get(rolled(name), -1)
        votes = [sum(int(code.groups[c]) == g for c in seen) for g in range(lm.GROUPS)]
        group = votes.index(max(votes)) + 1 if seen else 0
        last = seen[-1] + 1 if seen else 0
        last_two = last * 300 + (seen[-2] + 1 if len(seen) > 1 else 0)
        contexts = [0, *[scalar_mix(v + (salt << 32) & M64) >> 32 for salt, v in ((1, before), (2, group), (3, last_two))]]
        items = [(int(code.codes[symbol if symbol >= 0 else code.escape]), int(code.lengths[symbol if symbol >= 0 else code.escape]), contexts, None)]
        for i, value in enumerate((*name, 32) if symbol < 0 else ()):
            back = [name[i - k] if i >= k else 0 for k in range(1, 5)]
            history = []
            for k in (2, 3, 4):
                joined = sum(b << 8 * (k - 1 - n) for n, b in enumerate(back[:k]))
                history.append(scalar_mix(joined + (k << 56) + (group << 40) & M64) >> 32)
            history.append((rolled(name[:i]) + (9 << 32) & M64) >> 32)
            items.append((int(code.byte_codes[value]), int(code.byte_lengths[value]), history, 4 + min(i, 3)))
        token = []
        for path, length, context, kind in items:
            for j in range(length):
                n = node((1 << j) | (path >> (length - j)))
                token.append(([slot(n, c) for c in context], path >> (length - j - 1) & 1, min(j // 3, 3) if kind is None else kind))
        out.append(token)
        if name is not None:
            cls = int(code.classes[symbol]) if symbol >= 0 else -1
            before = cls if cls >= 0 else 256 + (name[-1] * 31 + name[max(len(name) - 2, 0)]) % 256
            if cls >= 0:
                seen.append(cls)
    return out


def test_lm_against_plain_python():
    """Counts of the slots, and the bits of each text, decision by decision; weights step after each block of tokens."""
    texts = [r[1] or "" for r in corpus() if len(r[1] or "") < 3000][:30]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    part = lm.Texts(lm.LOWER[raw], offsets)
    hashes, _, which = part.distinct()
    uses = np.bincount(which)
    code = lm.Code(np.append(hashes[uses > 2], [lm.END, lm.ESCAPE]), np.append(uses[uses > 2], [len(texts), 40]))
    shared = lm.shared_texts(iter([(raw, offsets)]), code)
    has = [{int(code.classes[code.find(hashes[[w]])[0]]) for w in which[part.first[i] : part.first[i + 1]] if uses[w] > 2} for i in range(len(texts))]
    for a in range(12):
        assert [int(shared[a, b]) for b in range(12)] == [sum(a in s and b in s for s in has) for b in range(12)]
    code.groups = lm.word_groups(shared[: lm.FREQUENT])
    code.spell_with(shared[lm.FREQUENT])
    assert set(code.groups.tolist()) <= set(range(lm.GROUPS)) and len(set(code.groups.tolist())) > 1
    s = lm.Settings(slots_log2=12, block=4, together=16, rate=0.05)
    found = [scalar_decisions(t, code, s.slots_log2) for t in texts]
    counts = np.zeros((lm.CONTEXTS, 2, 1 << s.slots_log2), np.int64)
    for tokens in found:
        for slots, bit, _ in (d for token in tokens for d in token):
            for k, x in enumerate(slots):
                counts[k, bit, x] += 1
    held = lm.count_slots(iter([(raw, offsets)]), code, s, 0, 1 << s.slots_log2)
    assert all((held.page(k, 0, 1 << s.slots_log2) == counts[k]).all() for k in range(lm.CONTEXTS))
    tables = lm.stored(counts)
    weights = np.random.default_rng(3).random((lm.GATES, lm.CONTEXTS)).astype(np.float32)
    got, n_tokens = lm.text_bits(raw, offsets, code, tables, weights, s)
    for text, tokens, bits, n in zip(texts, found, got, n_tokens):
        own = np.zeros((lm.KINDS, lm.CONTEXTS + 1))
        total = 0.0
        for at in range(0, len(tokens), s.block):
            steps = np.zeros_like(own)
            for slots, bit, kind in (d for token in tokens[at : at + s.block] for d in token):
                cell = [int(tables[k, x]) for k, x in enumerate(slots)]
                x = [((c & 255) - 128) / lm.STRETCH for c in cell]
                gate = (kind * 4 + (cell[1] >> 8)) * 4 + (cell[2] >> 8)
                odds = sum((float(weights[gate, k]) + own[kind, k]) * x[k] for k in range(lm.CONTEXTS)) + own[kind, lm.CONTEXTS]
                miss = bit - 1 / (1 + math.exp(-min(max(odds, -14), 14)))
                total -= math.log2(1 - abs(miss))
                steps[kind] += s.rate * miss * np.array([*x, 1])
            own += steps
        assert n == len(tokens) and bits == pytest.approx(total, rel=2e-4), text


def coded_texts(n=60):
    """Some texts, with a code in which rare words are spelled."""
    texts = [r[1] or "" for r in corpus() if len(r[1] or "") < 3000][:n]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    hashes, _, which = lm.Texts(lm.LOWER[raw], offsets).distinct()
    uses = np.bincount(which)
    code = lm.Code(np.append(hashes[uses > 2], [lm.END, lm.ESCAPE]), np.append(uses[uses > 2], [len(texts), 40]))
    code.groups = np.arange(lm.FREQUENT) % lm.GROUPS
    return raw, offsets, code


def test_lm_counts_a_node_of_a_context_once():
    """op2's counts take each node of the code once a context and bit, with its uses, however often the texts meet it."""
    raw, offsets, code = coded_texts()
    t = lm.Tokens(raw, offsets, code, 1 << 40)
    slots, bit, _, _, coded = lm.decisions(t, 0, len(t.doc), code, 24)
    for k in (0, 2):
        slot, bits, uses = lm.branches(t.path[: t.n_items], t.length[: t.n_items], t.item, t.context[k], 24)
        met = Counter(zip(slots[k, :coded].tolist(), bit[:coded].tolist()))
        got = Counter()
        for a, b, n in zip(slot.tolist(), bits.tolist(), uses.tolist()):
            got[a, b] += n
        assert got == met and len(slot) < coded / 3
        assert len(slot) <= 2 * len(code.hashes) * len(np.unique(t.context[k]))
    counts, whole = lm.Slots(4, 4), lm.Slots(4, 4)
    slot, bits, uses = np.array([5, 5, 6, 9, 5, 7]), np.array([1, 1, 0, 0, 0, 1]), np.array([40_000, 3, 70_000, 8, 2, 32_768])
    counts.add_uses(2, slot, bits, uses)
    whole.add_to(2, np.repeat(slot, uses), np.repeat(bits, uses))
    assert counts.page(2, 0, 4).tolist() == whole.page(2, 0, 4).tolist() == [[0, 2, 70_000, 0], [0, 40_003, 0, 32_768]]
    assert all(len(x) == 0 for x in lm.branches(code.codes[:0], code.lengths[:0], np.zeros(0, np.int64), np.zeros(0, np.uint32), 24))


def test_lm_looks_up_few_contexts_once():
    """What is looked up for each item is what every decision finds by itself."""
    raw, offsets, code = coded_texts()
    tables = lm.stored(np.random.default_rng(2).integers(0, 12, (lm.CONTEXTS, 2, 1 << 16)))
    for block in (32, 1 << 40):
        t = lm.Tokens(raw, offsets, code, block)
        look = lm.Lookup(t, tables, 16)
        assert len(look.alone) < len(t.doc) * 4
        for lo, hi in ((0, len(t.doc)), (7, 900), (50, 51)):
            slots, bit, kind, owner, coded = lm.decisions(t, lo, hi, code, 16)
            x, gate = lm.inputs(tables, slots, kind)
            d, got, got_gate = look(lo, hi)
            assert (got.T == x).all() and (got_gate == gate).all() and (d.bit == bit).all() and d.coded == coded
    one = [lm.text_bits(raw, offsets, code, tables, np.full((lm.GATES, lm.CONTEXTS), 0.3), lm.Settings(slots_log2=16, together=n, rate=0.05))[0] for n in (40, 1 << 13)]
    assert one[0] == pytest.approx(one[1], rel=1e-5)


def test_lm_learns_from_all_training_texts(spark, monkeypatch):
    rows = [(i, f"ab{i % 7} cd{i % 11} ef " * (1 + i % 5)) for i in range(60)] + [(1000, "zz " * 40)]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    shared, slopes, passes = lm.learn_from, lm.fit_weights, []

    def fit(parts, *rest):
        passes.append(sorted(r.text for texts, _ in parts for r in texts.collect()))
        return slopes(parts, *rest)

    groups = []
    monkeypatch.setattr(lm, "learn_from", lambda texts, *rest: groups.append(sorted(r.text for r in texts.collect())) or shared(texts, *rest))
    monkeypatch.setattr(lm, "fit_weights", fit)
    s = lm.replace(SMALL, weight_texts=5)
    assert lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), s).count() == len(rows)
    every = sorted(t for _, t in known)
    assert groups == [every] and passes[-1] == every
    # The sum over tasks is that of one.
    parts = spark.createDataFrame([(i, bytearray(zlib.compress(np.full(3, i).tobytes()))) for i in range(9)], "task long, sums binary")
    assert lm.summed(parts, np.int64, 2).tolist() == [36, 36, 36]


def test_slopes():
    raw, offsets = np.frombuffer(b"ab cd ab ef gh abab cd", np.uint8), np.array([0, 11, 22])
    hashes = np.unique(lm.Texts(raw, offsets).distinct()[0])[:3]
    code = lm.Code(np.append(hashes, [lm.END, lm.ESCAPE]), np.array([5, 4, 3, 2, 2]))
    s = lm.Settings(slots_log2=8)
    tables = lm.stored(np.random.default_rng(2).integers(0, 12, (lm.CONTEXTS, 2, 256)))
    weights = np.random.default_rng(3).random((lm.GATES, lm.CONTEXTS))
    want = np.zeros((lm.GATES, 1 + lm.CONTEXTS + lm.CONTEXTS**2))
    t = lm.Tokens(raw, offsets, code, 1 << 40)
    slots, bit, kind, *_ = lm.decisions(t, 0, len(t.doc), code, 8)
    x, gate = lm.inputs(tables, slots, kind)
    for i, g in enumerate(gate):
        p = 1 / (1 + math.exp(-float(x[:, i] @ weights[g])))
        want[g] += [1, *(x[:, i] * (bit[i] - p)), *(np.outer(x[:, i], x[:, i]) * p * (1 - p)).ravel()]
    assert lm.slopes(iter([(raw, offsets)]), tables, code, weights, s) == pytest.approx(want, abs=1e-3)


def test_lm_beats_its_base(spark):
    """On held-out texts of words from a few stems, in two languages, the model gives more probability than the unigram base."""
    rng = random.Random(12)
    stems = [["ka", "to", "mi", "ru", "shi", "ne", "go"], ["ber", "ung", "sch", "ein", "tz", "ol", "ar"]]
    make = lambda k: "".join(rng.choice(stems[k]) for _ in range(min(1 + int(rng.expovariate(0.6)), 6)))
    rows = [(i, " ".join(make(i % 2) for _ in range(rng.randint(40, 120)))) for i in range(900)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def labelled_texts(spark, mark):
    """Texts of two kinds, of which one holds marked words."""
    rng = random.Random(9)
    plain = ["".join(rng.choice("bdfglmnprstaeiou") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, known = [], []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(rng.randint(15, 60))]
        if i % 3 == 0:
            words = mark(words, rng)
        rows.append((i, " ".join(words)))
        known.append((i, int(i % 3 != 0), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")


def rate(scored, wanted):
    held = [r for r in scored if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in scored)
    return sum(r.predicted == wanted(r.doc_id) for r in held) / len(held)


def test_quality(spark, docs, labels):
    texts, known = labelled_texts(spark, lambda words, rng: [w.upper() + "!!" for w in words])
    assert rate(quality.score_quality(texts, known).collect(), lambda i: int(i % 3 != 0)) > 0.95
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is not None} == {True, False}
    assert quality.score_quality(empty(spark), labels).count() == 0
    assert quality.score_quality(docs, labels.limit(0)).count() == len(corpus())


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 80)
    import pyarrow as pa

    texts = pa.array([("good fine " if k else "bad poor ") + str(rng.integers(1000)) for k in y])
    weight, square, slope, offset = quality.train(texts, y, quality.Settings(features_log2=14))
    score = quality.score_texts(texts, weight, square, slope, offset)
    assert ((score > 0.5) == y).all()


def test_toxicity(spark, docs, labels):
    insults = ["gromblax", "gromblaxer", "zwickful", "zwickfully"]

    def mark(words, rng):
        words[rng.randrange(len(words))] = rng.choice(insults)
        words[rng.randrange(len(words))] = rng.choice(insults)
        return words

    texts, known = labelled_texts(spark, mark)
    small = toxicity.Settings(buckets_log2=14, window_epochs=40)
    assert rate(toxicity.score_toxicity(texts, known, settings=small).collect(), lambda i: int(i % 3 == 0)) > 0.95
    # A misspelling that was never seen shares n-grams with what was.
    odd = spark.createDataFrame([(1, "den bolu gromblaxxer ten"), (2, "den bolu ten"), (3, None), (4, "")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(odd, known, source=texts, settings=small).collect()}
    assert score[1] > 0.7 > score[2] and 0 <= score[3] == score[4] <= 1
    got = toxicity.score_toxicity(docs, labels, settings=small).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(empty(spark), labels, settings=small).count() == 0
    kept = toxicity.keep_civil(docs, labels.limit(0), settings=small)
    assert kept.columns == docs.columns and kept.count() == len(corpus())


def test_language(spark, docs):
    rng = random.Random(2)
    sounds = {"aa": ["ka", "to", "mi", "ru", "shi"], "bb": ["sch", "ein", "ung", "ber", "tz"], "cc": ["eau", "ille", "qu", "ment", "é"]}
    word = lambda k: "".join(rng.choice(sounds[k]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(240):
        k, other = sorted(sounds)[i % 3], sorted(sounds)[(i + 1) % 3]
        rows.append((i, " ".join(word(k) for _ in range(30)) + " " + " ".join(word(other) for _ in range(8)), k))
    small = langid.Settings(features_log2=13, steps=80, batch=32)
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_languages(texts, small).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and sum(got[i].lang_pred == sorted(sounds)[i % 3] for i in held) / len(held) > 0.95
    odd = texts.unionByName(spark.createDataFrame([(1001, None, "aa"), (1002, "12 +3 — 🎉", "bb"), (1003, " ".join(["schein"] * 5000), None), (1004, "你好", None)], texts.schema))
    got = {r.doc_id: r for r in langid.identify_languages(odd, small).collect()}
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und", "und", "bb"] and got[1002].score == 0 and got[1004].lang_pred in sounds
    assert langid.identify_languages(empty(spark), small).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(texts.withColumn("lang", F.lit(None).cast("string")), small).collect()} == {"und"}
    assert langid.identify_languages(docs, small).count() == len(corpus())


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    emission, move, start = rng.random((7, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    first = np.array([0, 4, 4, 7])
    got = langid.forward_backward(emission, first, move, start)
    for a, b in ((0, 4), (4, 7)):
        total = np.zeros((b - a, 3))
        for path in product(range(3), repeat=b - a):
            p = start[path[0]] * np.prod([emission[a + t, k] for t, k in enumerate(path)]) * np.prod([move[i, j] for i, j in zip(path, path[1:])])
            for t, k in enumerate(path):
                total[t, k] += p
        assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True))


def plain_marginals(emission, move, start):
    """Forward-backward, word by word."""
    n = len(emission)
    alpha, beta = np.zeros_like(emission), np.ones_like(emission)
    for t in range(n):
        alpha[t] = emission[t] * (start if t == 0 else alpha[t - 1] @ move)
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = move @ (emission[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_of_long_texts_is_exact():
    rng = np.random.default_rng(4)
    length = [5000, 0, 1, 513, 512, 1024, 3]
    emission, move, start = rng.random((sum(length), 3)) ** 4 + 1e-4, np.eye(3) * 9 + rng.random((3, 3)), rng.random(3)
    first = np.concatenate(([0], np.cumsum(length)))
    for segment in (512, 7, 1 << 20):
        got = langid.forward_backward(emission, first, move, start, segment)
        for a, b in zip(first[:-1], first[1:]):
            assert np.allclose(got[a:b], plain_marginals(emission[a:b], move, start), atol=1e-12)


def test_language_training_follows_the_gradient():
    """One step of training lowers the loss as finite differences say: the gradient of transitions against them."""
    rng = np.random.default_rng(2)
    emission, move, gold = np.exp(rng.normal(size=(6, 3))), rng.normal(size=(3, 3)), rng.integers(0, 3, 6)

    def loss(m):
        f = np.exp(m)
        alpha, total = emission[0].copy(), 0.0
        for t in range(1, 6):
            total, alpha = total + np.log(alpha.sum()), alpha / alpha.sum()
            alpha = emission[t] * (alpha @ f)
        score = np.log(emission[range(6), gold]).sum() + m[gold[:-1], gold[1:]].sum()
        return total + np.log(alpha.sum()) - score

    factor = np.exp(move)
    alpha, beta = np.empty_like(emission), np.ones_like(emission)
    for t in range(6):
        alpha[t] = emission[t] * (1 if t == 0 else alpha[t - 1] @ factor)
    for t in range(4, -1, -1):
        beta[t] = factor @ (emission[t + 1] * beta[t + 1])
    got = langid.expected_moves(alpha[None], beta[None], emission[None], factor)
    np.subtract.at(got, (gold[:-1], gold[1:]), 1)
    for i in range(3):
        for j in range(3):
            step = np.zeros((3, 3))
            step[i, j] = 1e-5
            assert got[i, j] == pytest.approx((loss(move + step) - loss(move - step)) / 2e-5, abs=1e-6)


def test_samples_leave_no_length_out(spark):
    """The sample ends with the text that passes the bound; a long text is in it as its place in the order says."""
    from mergeloom.llm.sample import labelled_sample

    rows = [(i, "x" * (50_000 if i % 10 == 0 else 100)) for i in range(200)] + [(3, "w" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    texts, y = labelled_sample(docs, labels, "quality", F.lit(True), 1000, 10**9)
    assert len(y) == 200 and sum(len(t) == 50_000 for t in texts.to_pylist()) == 20 and "w" * 100 in texts.to_pylist()
    texts, y = labelled_sample(docs, labels, "quality", F.lit(True), 1000, 120_000)
    sizes = [sum(len(t) for t, k in zip(texts.to_pylist(), y) if k == label) for label in (0, 1)]
    assert 120_000 <= sizes[0] < 170_000 and sizes[1] == 100 * 100
    assert len(labelled_sample(docs, labels, "quality", F.lit(True), 30, 10**9)[1]) == 60


def test_pipeline(spark, docs, labels, tmp_path):
    """Each stage against a brute-force version of it, on its own input."""
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "bpe"]
    at, held = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{sf}/{name}")
        at = spark.read.parquet(f"{sf}/{name}")
        held.append(at.collect())
    civil, lines, distinct, mixed, encoded = held
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if r.predicted}
    assert sorted(str(r.doc_id) for r in civil) == sorted(str(r[0]) for r in corpus() if r[0] not in toxic)
    assert len(lines) == len(civil) and sum(r.n_chars for r in lines) <= sum(len(r.text or "") for r in civil)
    prints = {r.doc_id: brute_fingerprint(r.text) for r in distinct if r.doc_id is not None}
    assert all((a ^ b).bit_count() > 4 for i, a in prints.items() for j, b in prints.items() if i < j)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in distinct}
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in mixed)
    rows = corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in rows) == Counter((r.doc_id, r.ids_sha256) for r in encoded)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), sf).count() == 0


def test_registered():
    assert sorted(registered.queries(), key=lambda n: int(n[2:].split("_")[0])) == list(registered.queries())
    assert len(registered.queries()) == 10 and set(registered.oracle_sql()) <= set(registered.queries())
