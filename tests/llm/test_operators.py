"""Each operator against a plain version, and on hard rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspark.llm import chat_format, common, decontamination, ngram_join, packing, quality_classifier, quality_rules, queries, suffix_dedup, token_counts, toxicity, url_filter
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest long, hash long, id long, spans string, n_bytes long, `row` int, y int, cls string, unit int, repeats int"
WORD = "one two three four five six seven eight nine ten eleven twelve".split()


def rows(texts):
    return [(i, t, "en", f"s{i % 3 if i is not None else 0}", len(t or ""), 1, 2, 3, "x", 4, 5, 6, "c", 7, 8) for i, t in texts]


def hard_texts():
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(WORD) + str(rng.randrange(50)) for _ in range(n))
    passage, base = say(80), [rng.choice(WORD) + str(rng.randrange(99)) for _ in range(120)]
    near = lambda k: " ".join(w if i not in k else "changed" + str(i) for i, w in enumerate(base))
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (None, "a b"), (None, None), (5, say(3000)), (6, "x " * 4000), (7, passage + say(60)), (8, say(70) + passage)]
    out += [(10, near([])), (11, near([60])), (12, near([3, 60])), (13, near([3, 110])), (14, " ".join(base).upper()), (15, near(range(0, 120, 9)))]
    out += [(20, "é" * 900), (21, "ab" * 700 + say(5)), (22, "line one here\n" * 30 + say(60)), (23, passage), (23, say(90)), (24, "ünïcødé " * 80 + "\u2028\x1c\u00a0 end"), (25, "🙂 " * 60)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(hard_texts()), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(1, 26)] + [(None, 1, True), (4, None, None), (4, 0, False)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int")).withColumn("text", F.lit("clash"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_all_operators_have_a_query():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 11))


# token counts


def best_tokens(word, model):
    pieces, byte, _ = model
    text = token_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        width = len(text[end - 1].encode())
        options = [(-(best[end - 1][0] + byte * width), best[end - 1][1] + width)]
        options += [(-(best[s][0] + pieces[text[s:end]]), best[s][1] + 1) for s in range(end) if text[s:end] in pieces]
        low = min(options)
        best.append((-low[0], low[1]))
    return best[-1][1]


def test_token_counts(docs, nothing):
    model = token_counts.unigram_model(public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in hard_texts():
        words = [w.decode() for w in (t or "").encode().split()]
        cache = {w: best_tokens(w, model) for w in set(words)}
        want.append((i, len(words), sum(cache[w] for w in words)))
    got = [tuple(r) for r in token_counts.token_counts(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(nothing).count() == 0


def test_trie_scores_a_prefix_once():
    """Over several batches the trie has exactly the distinct prefixes, one node each, and their counts."""
    model = token_counts.unigram_model(public_tokenizers.path("piece_bpe_32k.model"))
    trie, rng = token_counts.PrefixTrie(model), random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(600)]
    for at in range(0, 600, 100):
        trie.insert(set(words[at : at + 100]) - set(trie.counts))
    assert len(trie.scores) == len(trie.edges) + 1 == len({w[:n] for w in words for n in range(len(w) + 1)})
    assert all(trie.counts[w] == best_tokens(w, model) for w in words)


# quality rules


def plain_rules(text, least=8, fraction=0.3, longest=150):
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    lines, seen, dup = [x for x in raw.split(b"\n") if x.split()], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    triples = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(n - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    most = [0] * n
    for d in range(1, n):
        run = 0
        for i in range(n - d - 1, -1, -1):
            run = run + 1 if words[i] == words[i + d] else 0
            most[i], most[i + d] = max(most[i], run), max(most[i + d], run)
    cover = {j for i, m in enumerate(most) if m >= least for j in range(i, i + m)}
    failed = n < 50 or 100 * len(hit) > 50 * n
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, chars, symbols, dup, len(hit), failed, len(cover), max(most, default=0), not failed and len(cover) <= fraction * n and max(most, default=0) <= longest


def test_quality_rules(docs, nothing):
    texts = [(i, t) for i, t in hard_texts() if i not in (5, 6)]
    want = [(i, *plain_rules(t)) for i, t in texts]
    got = [tuple(r) for r in quality_rules.quality_rules(docs.where("doc_id is null or doc_id not in (5, 6)")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert quality_rules.quality_rules(nothing).count() == 0
    long = quality_rules.quality_rules(docs.where("doc_id = 6")).first()
    assert (long.n_words, long.n_repeat_words, long.longest_repeat, long.kept) == (4000, 4000, 3999, False)


def test_quality_rules_random(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    got = quality_rules.measure([t.encode() for t in texts], 4, 0.3, 20)
    for i, t in enumerate(texts):
        assert tuple(x[i] for x in got) == plain_rules(t, 4, 0.3, 20)


# n-gram join


def plain_components(texts):
    sets = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    up = list(range(len(texts)))
    find = lambda x: x if up[x] == x else find(up[x])
    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                up[find(a)] = find(b)
    ids = defaultdict(list)
    for x, (i, _) in enumerate(texts):
        if i is not None:
            ids[find(x)].append(i)
    return [(i, len(sets[x]), (min(ids[find(x)]) if ids[find(x)] else None) if sets[x] else i) for x, (i, _) in enumerate(texts)]


def test_jaccard_join(docs, nothing):
    got = [tuple(r) for r in ngram_join.jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(plain_components(hard_texts()), key=str)
    assert ngram_join.jaccard_join(nothing).count() == 0
    assert ngram_join.one_of_each(nothing).count() == 0


def near_group(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    out = []
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 6, 9])):
            words[k] = f"z{rng.randrange(5 if rng.random() < 0.3 else 10**6)}"
        out.append((1000 - i, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [24 << 20, 30_000])
def test_jaccard_group(spark, monkeypatch, block):
    """A group of near copies around the threshold; the small block deals it over many tasks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_group(160, 3)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows(texts), DOCS).repartition(4)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(texts))


def test_links_both_ways():
    """Listed pairs and matrices find the same links."""
    hashes = ngram_join.WordHashes()
    sets = [ngram_join.shingles(t, hashes) for _, t in near_group(90, 9)]
    every = {(a, b) for a in range(90) for b in range(a) if ngram_join.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}
    for limit in (0, 10**9):
        original = ngram_join.pairs_by_token
        ngram_join.pairs_by_token = lambda r, c, _, original=original, limit=limit: original(r, c, limit)
        try:
            x, y = ngram_join.links(sets, np.ones(90, bool), np.arange(90))
        finally:
            ngram_join.pairs_by_token = original
        assert {(max(p), min(p)) for p in zip(x.tolist(), y.tolist())} == every


def test_one_of_each(docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[4] == 1 and ids[10] == 1 and not {11, 12, 13, 14} & set(ids) and ids[1] == ids[2] == ids[3] == 1


# suffix-array dedup


def plain_dedup(texts, length):
    starts = Counter()
    raws = [(t or "").encode() for _, t in texts]
    for b in raws:
        starts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(texts, raws):
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                cover[k : k + length] = True
        spans = int((cover & ~np.r_[False, cover[:-1]]).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out.append((i, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,split", [(400, 512), (60, 512), (60, 1)])
def test_suffix_dedup(docs, monkeypatch, length, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(docs, length).drop("text").collect()]
    assert sorted(got, key=str) == sorted(plain_dedup(hard_texts(), length), key=str)


def test_suffix_dedup_random(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab") for _ in range(200)) for _ in range(4)]
    texts = [(i, "".join(p[rng.randrange(80) : 80 + rng.randrange(120)] for p in rng.choices(pool, k=3))) for i in range(50)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows(texts), DOCS).repartition(3), 50).drop("text").collect()
    assert sorted(map(tuple, got)) == sorted(plain_dedup(texts, 50))


def test_suffix_dedup_bound(spark):
    """Passages of 57 words in two texts each: the contract takes out 400 bytes and leaves 399, a call for 250 takes both."""
    rng = random.Random(12)
    passage = lambda tail: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(57)) + tail
    short, long = passage("."), passage("..")
    texts = [(1, "before 1" + short + "1 after"), (2, "2" + short + "2"), (3, "before 3" + long + "3 after"), (4, "4" + long + "4")]
    assert [len(p.encode()) for p in (short, long)] == [399, 400]
    for length, removed in ((400, [0, 0, 400, 400]), (250, [399, 399, 400, 400])):
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows(texts), DOCS), length).orderBy("doc_id").collect()
        assert [r.n_removed for r in got] == removed and [r.n_bytes for r in got] == [len(t) for _, t in texts]


def test_suffix_dedup_parts(spark, nothing):
    """Texts longer than a part are taken in overlapping parts."""
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(5000))
    texts = [(1, text), (2, text[1000:2000] + "x" * 10)]
    parts = [(0, p, text.encode()[p : p + 700 + 99]) for p in range(0, 5000 - 99, 700)]
    part, _, _, first, n, times = suffix_dedup.find_runs(parts, 100)
    covered = sorted(x for f, k, m in zip(first, n, times) for x in range(f, f + k * m))
    assert covered == list(range(4901))
    assert suffix_dedup.suffix_dedup(nothing, carry=True).count() == 0
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows(texts), DOCS), carry=True).where("doc_id = 2").first()
    assert got.text == "x" * 10 and got.row.n_bytes == 4


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 6))]
        flat, end = [], []
        for k, t in enumerate(texts):
            stop = len(flat) + len(t)
            flat += [ord(c) for c in t] + [-1 - k]
            end += [stop] * (len(t) + 1)
        ids, end = np.array(flat), np.array(end)
        order, _ = common.suffix_ranks(np.unique(ids, return_inverse=True)[1].astype(np.int64), end, 1)
        suffix = lambda i: flat[i : end[i] + 1]
        assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(flat)))
        lcp = common.kasai(ids, order, end)
        for a, b in zip(order, order[1:]):
            x, y = suffix(a)[:-1], suffix(b)[:-1]
            assert lcp[b] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


# benchmark decontamination


def edited(rng, words, k, pool):
    out = list(words)
    for _ in range(k):
        p, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[p] = rng.choice(pool)
        elif kind == 1:
            out.insert(p, rng.choice(pool))
        elif len(out) > 1:
            del out[p]
    return out


def plain_distance(pattern, text):
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def test_search_equals_plain():
    rng = random.Random(6)
    for _ in range(200):
        p, t = [rng.randrange(3) for _ in range(rng.randrange(1, 9))], [rng.randrange(3) for _ in range(rng.randrange(0, 15))]
        assert decontamination.search(p, t)[0] == plain_distance(p, t)


def test_decontamination(spark, docs, nothing):
    """Recall at and under the threshold against brute force, and nothing over it."""
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(pool) for _ in range(rng.randrange(8, 60))]) for i in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w).title() + ".") for i, w in items] + [(90, None), (None, "a b c d e f"), (91, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    texts, pads = [], lambda: [rng.choice(pool) for _ in range(40)]
    for n, (_i, w) in enumerate(items * 6):
        texts.append((n, " ".join([*pads(), *edited(rng, w, rng.randrange(0, len(w) // 4 + 1), pool), *pads()]).replace(" ", ", ", 3)))
    clean = [(1000 + n, " ".join(rng.choice(pool) for _ in range(120))) for n in range(40)]
    found = decontamination.decontaminate(spark.createDataFrame(rows(texts + clean), DOCS), bench).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    want = {}
    for n, t in texts:
        w = [x.decode() for x in decontamination.words_of(t)]
        i, pattern = items[n % 60]
        d = plain_distance(pattern, w)
        if d <= int(0.2 * len(pattern) + 1e-9):
            want[n, i] = d
    assert len(set(want) & set(got)) >= 0.97 * len(want)
    assert all(got[k] == d for k, d in want.items() if k in got)
    assert not [k for k in got if k[0] >= 1000]
    assert decontamination.decontaminate(nothing, bench).count() == 0
    assert decontamination.decontaminate(docs, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 0
    assert decontamination.clean(docs, bench).count() == docs.count()
    dirty = spark.createDataFrame(rows(texts[:60] + clean), DOCS)
    kept = {r.doc_id for r in decontamination.clean(dirty, bench).collect()}
    assert kept == {r.doc_id for r in dirty.collect()} - {d for d, _ in got}


# packing


def test_packing(docs, nothing):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    found = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at and r.length > 0
            at += r.length
        assert 2028 <= at <= 2048 or at & (at - 1) == 0
    want = Counter()
    for i, t in hard_texts():
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] += len(ids)
        pieces = {(r.start, r.length): r for r in by_doc[i]}
        if sum(i == j for j, _ in hard_texts()) == 1:
            assert sum(r.length for r in by_doc[i]) == len(ids)
            for (start, length), r in pieces.items():
                assert zlib.crc32(ids[start : start + length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    assert {i: sum(r.length for r in parts) for i, parts in by_doc.items()} == dict(want)
    assert packing.pack(nothing).count() == 0


def test_ranks_equal_tokenizer():
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(32, 0x250)] + list("\n\t –—’“”…€") + ["<|endoftext|>", "the ", " and", "  ", "İ"]
    vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    exact, _ = packing.encoders(vocabulary, ranks)
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randrange(0, 60)))
        assert packing.token_ids(text, vocabulary, ranks, 1).tolist() == [*exact.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("slack", [0, 20])
def test_little_is_cut(slack):
    """Most tokens lie where the rule put them; padding stays within the bound; each token lies once, without gaps."""
    rng = np.random.default_rng(2)
    size, lengths = 2048, np.minimum(np.exp(rng.normal(6.6, 1, 8000)).astype(int) + 1, 60_000)
    rows_ = list(packing.packed(((i, np.zeros(n, "<u4")) for i, n in enumerate(lengths)), size, 0, slack))
    share = Counter()
    fill, pieces = defaultdict(list), defaultdict(list)
    for doc, start, n, _, total, window, offset, placed in rows_:
        share[placed] += n
        fill[window].append((offset, n))
        pieces[doc].append((start, n))
        assert total == lengths[doc]
    padding = 0
    for held in fill.values():
        assert all(b[0] == sum(a) for a, b in zip(sorted(held), sorted(held)[1:]))
        used = sum(n for _, n in held)
        padding += size - used if used & (used - 1) else 0
        assert size - slack <= used <= size or used & (used - 1) == 0
    for doc, held in pieces.items():
        assert sum(n for _, n in held) == lengths[doc] and all(b[0] == sum(a) for a, b in zip(sorted(held), sorted(held)[1:]))
    assert set(pieces) == set(range(8000)) and padding <= (0 if slack == 0 else 0.005 * lengths.sum())
    assert share["cut"] < (0.05 if slack else 0.3) * lengths.sum()


def test_sum_of_squares_choice():
    level = packing.SumOfSquares(10)
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 10)
        counts = level.counts.copy()
        options = {}
        for h in [0, *np.flatnonzero(counts[: 10 - n + 1]).tolist()]:
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + n < 10:
                c[h + n] += 1
            options[h] = int((c[:10] ** 2).sum())
        _, chosen = level.place(n)
        assert options[chosen] == min(options.values())


# chat


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> and [\\\\INST]", None, "", "\\", "[/INST]", "a\nb", "<s>[INST] user [/INST]hi</s>", "<\\s><s>\\"]
    turns = [(1, i, ("user", "assistant", None, "sys [/INST] x")[i % 4], t) for i, t in enumerate(texts)] + [(2, 0, "assistant", "plain"), (2, 0, "assistant", "plain"), (None, None, None, None), (3, None, "user", "<s>")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.chat_format(frame).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in turns[: len(texts)]]
    assert got[1].escaped and not got[2].escaped and not got[3].escaped
    assert [got[2].formatted[s.start : s.start + s.length] for s in got[2].loss_spans] == ["plain", "plain"]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert chat_format.chat_format(frame.limit(0)).count() == 0


# URLs


def test_url_filter(spark):
    cases = {
        "http://A.Example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/17#x": ("example.org", "/en/17", "example.org/en/1", "block"),
        "x://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
        "http://b.com?x=/de/": ("b.com", "", None, None),
        "http://org": ("org", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(cases)] * 2, "page_id int, url string, n_good string")
    got = url_filter.url_filter(pages).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_url_filter_blocks_by_the_lower_bound(spark):
    """Rules of equal length: the first counts. A host with bad outcomes is blocked where no rule fits, a good one stays; long URLs are whole."""
    rules = (("allow", "a.com", "/x"), ("block", "b.com", "/x"), ("block", "a.com", "/y"), ("allow", "b.com", "/y"), ("block", "a.com", "/x"))
    urls = ["http://a.com/x"] * 40 + ["http://b.com/x"] * 40 + ["http://a.com/q" + "z" * 200_000, "http://b.com/q", "http://www.b.com/q"]
    got = url_filter.url_filter(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string"), rules=rules).collect()
    said = {r.page_id: r.verdict for r in got}
    assert [said[i] for i in (0, 40, 80, 81)] == ["allow", "block", "allow", "block"]
    assert {len(r.path) for r in got if r.page_id == 80} == {200_002}


def test_suffixes_of_a_table(spark):
    hosts = [(h, 1) for h in ("a.city.kawasaki.jp", "b.kawasaki.jp", "x.co.uk", "y.co.uk", "co.uk", "z.org", "org", "")]
    known = spark.createDataFrame([("jp",), ("kawasaki.jp",), ("city.kawasaki.jp",), ("co.uk",), ("uk",), ("Org",), (None,)], "suffix string")
    got = url_filter._registered(spark.createDataFrame(hosts, "host string, n int"), known)
    assert {(r.host, r.suffix, r.domain) for r in got.collect()} == {
        ("a.city.kawasaki.jp", "city.kawasaki.jp", "a.city.kawasaki.jp"), ("b.kawasaki.jp", "kawasaki.jp", "b.kawasaki.jp"), ("x.co.uk", "co.uk", "x.co.uk"), ("y.co.uk", "co.uk", "y.co.uk"),
        ("co.uk", "co.uk", "co.uk"), ("z.org", "org", "z.org"), ("org", "org", "org"), ("", "", ""),
    }


def test_host_reputation_shrinks(spark):
    outcomes = [("bad.a.com", 0)] * 40 + [("good.b.com", 1)] * 40 + [("few.b.com", 0)] + [("none.b.com", None), (None, None)]
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(outcomes, "host string, outcome int")).collect()}
    assert got["bad.a.com"].host_mean < 0.2 < got["few.b.com"].host_mean < got["none.b.com"].host_mean < got["good.b.com"].host_mean
    assert got[""].n_labelled == 0


# classifiers


def test_quality_classifier(spark, docs, nothing, labels):
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.quality_classifier(nothing, labels).count() == 0
    bare = quality_classifier.quality_classifier(docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 0.1 for r in bare)
    kept = quality_classifier.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)


def test_quality_classifier_held_out(spark):
    """Fitted without a fifth of the labels, it has to get them right."""
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    got = quality_classifier.quality_classifier(docs, labels.where(F.col("doc_id") % 5 != 0)).join(labels.where(F.col("doc_id") % 5 == 0), "doc_id")
    share = got.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert share > 0.95


def plain_sites(rows_):
    """(root, host rate, path rate) of each row (host, path, good, weight) without its own outcome."""

    def strength(groups):
        groups = [g for g in groups if g[0] > 0]
        total, squares = sum(n for n, _, _ in groups), sum(n * n for n, _, _ in groups)
        inner = sum(n * p * (1 - p) for n, _, p in groups)
        rho = 1e-6
        if len(groups) > 1 and inner > 0:
            spread = sum(n * (k / n - p) ** 2 for n, k, p in groups)
            rho = max(rho, (spread / (inner / total) - len(groups) + 1) / (total - squares / total - len(groups) + 1))
        return min(1000, max(2, 1 / rho - 1))

    hosts, paths = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for host, path, good, weight in rows_:
        for sums in (hosts[host], paths[host, path]):
            sums[0] += weight
            sums[1] += weight * good
    root = (sum(k for _, k in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    top = strength([(n, k, root) for n, k in hosts.values()])
    rate = {h: (top * root + k) / (top + n) for h, (n, k) in hosts.items()}
    low = strength([(n, k, rate[h]) for (h, _), (n, k) in paths.items()])
    out = []
    for host, path, good, weight in rows_:
        n, k = hosts[host]
        above = (top * root + k - weight * good) / (top + n - weight)
        n, k = paths[host, path]
        out.append((root, above, (low * above + k - weight * good) / (low + n - weight)))
    return out


def test_sites_against_brute_force(spark):
    rng = random.Random(9)
    rows_ = [(h := rng.choice("abcdef"), rng.choice("xyz"), float(rng.random() < ord(h) % 7 / 7), rng.choice([1.0, 1.0, 0.3])) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "i int, host string, path string, good double, weight double")
    sites = quality_classifier.Sites(df)
    host, path = sites.rates(F.col("good"), F.col("weight"))
    got = {r.i: (r.h, r.p) for r in df.join(sites.counts, ["host", "path"]).select("i", host.alias("h"), path.alias("p")).collect()}
    for i, (root, above, rate) in enumerate(plain_sites(rows_)):
        assert math.isclose(sites.root, root) and np.allclose(got[i], (above, rate))


def test_quality_classifier_against_brute_force(spark):
    """Scores of all documents from their own evidence and plain sums over the sites."""
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    texts = {r.doc_id: r for r in docs.collect()}
    x = np.array([quality_classifier.features(texts[i].text) for i in sorted(known) if i in texts])
    y = np.array([known[i] for i in sorted(known) if i in texts], float)
    order = np.lexsort([y, *x.T])
    model = quality_classifier.fit(x[order], y[order])
    p = {i: 1 / (1 + math.exp(-quality_classifier.evidence([r.text], model)[0])) for i, r in texts.items()}
    ids = sorted(texts)
    site = [(texts[i].source or "", texts[i].lang or "") for i in ids]
    rates = plain_sites([(*s, float(known.get(i, p[i])), 1.0 if i in known else (2 * p[i] - 1) ** 2) for i, s in zip(ids, site)])
    odds = lambda q: math.log(q / (1 - q))
    got = {r.doc_id: r for r in quality_classifier.quality_classifier(docs, labels).collect()}
    for i, (root, above, rate) in zip(ids, rates):
        assert np.allclose([got[i].doc_score, got[i].host_rate, got[i].path_rate], [p[i], above, rate], atol=1e-9)
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-(odds(min(max(p[i], 1e-13), 1 - 1e-13)) + odds(rate) - odds(root)))), abs_tol=1e-9)


def test_toxicity(spark, docs, nothing, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 0 for i, _ in hard_texts()}
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_held_out(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    rows_ = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows_) / len(rows_)
    recall = sum(r.predicted for r in rows_ if r.toxic) / sum(r.toxic for r in rows_)
    assert right > 0.96 and recall > 0.8


def test_block_max_is_exact():
    """Against products of dense vectors, with ties, repeated examples, empty queries and more queries than a batch."""
    rng = np.random.default_rng(4)
    terms_of = [np.sort(rng.choice(40, rng.integers(0, 6), replace=False)).astype(np.int64) for _ in range(300)]
    vectors = [(t, rng.integers(1, 5, len(t))) for t in terms_of] + [(np.arange(3), np.ones(3, np.int64))] * 9
    index = toxicity.BlockMaxIndex(vectors, rng.integers(0, 2, len(vectors)), rng.uniform(0.5, 3, 40), block=16, k=7)
    n = len(vectors)
    dense = np.zeros((n, 41))
    of, term, weight = index.units([vectors[i] for i in index.order])
    dense[of, term] = weight
    assert np.allclose((dense * dense).sum(axis=1), 1)
    sims = np.rint(dense @ dense.T * 1e9) / 1e9
    places, found = index.nearest([vectors[i] for i in index.order])
    alone, _ = index.nearest([vectors[i] for i in index.order], np.arange(n))
    for place in range(n):
        want = np.lexsort((np.arange(n), -sims[place]))
        assert np.allclose(found[place], sims[place][want[:7]], atol=2e-9) and places[place].tolist() == want[:7].tolist()
        assert alone[place].tolist() == want[want != place][:7].tolist()
    few = toxicity.BlockMaxIndex(vectors[:3], np.array([0, 1, 0]), np.ones(40), k=7)
    assert few.nearest(vectors[:2], np.array([0, 1]))[0].tolist()[0].count(-1) == 1


def test_toxicity_against_brute_force(spark):
    """Every score and neighbour from whole texts in plain loops: terms, frequencies, weights, cosines, votes, calibration."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 200")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    marks = str.maketrans(dict.fromkeys(toxicity.MARKS.decode(), " "))

    def counts(text):
        out = Counter()
        for word in re.split("[ \t-\r]+", text.lower().translate(marks)):
            out.update([word] * (len(word) >= 3) + ["^" + word[:5]] * (len(word) > 5))
        return out

    terms = {i: counts(t) for i, t in texts.items()}
    frequency = Counter(t for c in terms.values() for t in c)
    vocabulary = {t for i in known for t in terms[i]}
    base = sum(known.values()) / len(known)
    lift = {}
    for t in vocabulary:
        has = [y for i, y in known.items() if t in terms[i]]
        lift[t] = (sum(has) + toxicity.SHRINK * base) / (len(has) + toxicity.SHRINK) / base

    def unit(c):
        v = {t: (1 + math.log(n)) * max(math.log((len(texts) + 1) / (frequency[t] + 0.5)), 0.01) * lift[t] for t, n in c.items() if t in vocabulary} | {"": toxicity.BIAS}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    units = {i: unit(c) for i, c in terms.items()}
    _, index, ids = toxicity.fit_index(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    assert sorted(ids) == sorted(known)
    rank = {i: at for at, i in enumerate(ids)}  # of equal similarities the first in the index counts

    def neighbours(i, alone):
        sims = {j: round(sum(x * units[j].get(t, 0.0) for t, x in units[i].items()), 9) for j in known if not (alone and i == j)}
        return [(j, sims[j]) for j in sorted(sims, key=lambda j: (-sims[j], rank[j]))[:15]]

    def odds(near):
        weight = [1 / (max(1 - s, 0) + 0.02) for _, s in near]
        share = (sum(w * known[j] for w, (j, _) in zip(weight, near)) + (sum(known.values()) + 1) / (len(known) + 2)) / (sum(weight) + 1)
        return math.log(share / (1 - share))

    x, y = np.array([odds(neighbours(i, True)) for i in ids]), np.array([known[i] for i in ids])

    def slope_of(a, b):
        p = 1 / (1 + np.exp(-(a * x + b)))
        return ((y - p) * x).sum() - 0.5 * (a - 1), (y - p).sum()

    assert max(map(abs, slope_of(index.slope, index.shift))) < 1e-5  # the best line of the penalised likelihood
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        near = neighbours(r.doc_id, False)
        assert math.isclose(r.score, 1 / (1 + math.exp(-(index.slope * odds(near) + index.shift))), abs_tol=1e-6)
        assert np.allclose([e.similarity for e in r.evidence], [s for _, s in near[:3]], atol=3e-9)


def test_toxicity_keeps_all_terms(spark):
    """Words that say nothing of the label still choose the neighbours, in a sample too small to choose words from."""
    texts = [(i, f"alpha{i} beta{i} gamma{i} delta{i} common words here", i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    known = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    asked = [(1000 + i, f"gamma{i} alpha{i} else") for i, _, _ in texts]
    found = toxicity.toxicity(spark.createDataFrame([x[:2] for x in texts] + asked, "doc_id long, text string"), known).where("doc_id >= 1000").collect()
    assert len(found) == len(texts) and all(r.evidence[0].doc_id == r.doc_id - 1000 and r.evidence[0].similarity > r.evidence[1].similarity for r in found)


def test_decontamination_finds_long_edited_items():
    """Items of 20 to 400 words with as many edits as the threshold allows, of each kind alone."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(2000)]
    items = [(i, [rng.choice(pool).encode() for _ in range(n)]) for i, n in enumerate([20, 59, 120, 250, 400] * 4)]
    index = decontamination.WindowIndex(items, 0.8, 24, 3)
    texts, want = [], set()
    for i, w in items:
        for kind in range(3):
            x = [t.decode() for t in w]
            for p in sorted(rng.sample(range(len(x)), index.allowed(len(x))), reverse=True):
                x[p : p + (kind != 2)] = [] if kind == 0 else [rng.choice(pool)]
            want.add((len(texts), i))
            texts.append(" ".join([*rng.choices(pool, k=30), *x, *rng.choices(pool, k=30)]))
    assert want <= {m[:2] for m in index.matches(texts)}


def test_decontamination_short_and_unspaced_items(spark):
    bench = spark.createDataFrame([(1, "quite brief item"), (None, "an item that has no id"), (2, "長い文章を書いて試験の問題にする。")], "item_id long, text string")
    texts = [(1, "So, a quite brief item is here"), (2, "here is an item that has no id at all"), (3, "これは長い文章を書いて試験の問題にすると言う"), (4, "a quite brief other item"), (5, "文章")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.decontaminate(docs, bench).collect()} == {(1, 1), (2, None), (3, 2)}
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == {4, 5}


def test_one_of_each_with_repeated_and_null_ids(spark):
    """Unlinked texts with one doc_id both stay; of near copies without ids one does."""
    rng = random.Random(8)
    say = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(80))
    one, two, three, four = (say() for _ in range(4))
    texts = [(23, one), (23, two), (24, two), (None, three), (None, three), (None, three + " end"), (None, four), (None, None), (None, None)]
    kept = ngram_join.one_of_each(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    left = Counter((r.doc_id, (r.text or "")[:20]) for r in kept)
    assert left == Counter({(23, one[:20]): 1, (23, two[:20]): 1, (None, three[:20]): 1, (None, four[:20]): 1, (None, ""): 2})


def test_decontamination_ties_repeats_and_long_texts(spark):
    """An item twice in a text is reported once, at its first place; repeated rows each; a match at the end of a long text."""
    item = "what is the capital of the old province beyond the river"
    other = " ".join(f"x{i}" for i in range(150_000))
    texts = [(1, f"so {item} and {item}"), (2, f"{item}"), (2, f"{item}"), (3, f"{other} {item}"), (4, other)]
    bench = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.start_word) for r in decontamination.decontaminate(spark.createDataFrame(rows(texts), DOCS), bench).collect())
    assert got == sorted((d, i, 0, at) for d, at in ((1, 1), (2, 0), (2, 0), (3, 150_000)) for i in (7, 8))
    assert [r.doc_id for r in decontamination.clean(spark.createDataFrame(rows(texts), DOCS), bench).collect()] == [4]


def test_chat_long_texts(spark):
    """A megabyte in a turn, with and without control strings, comes back whole."""
    texts = ["word " * 200_000, "</s>[INST] <\\\\s> " * 50_000, "plain"]
    frame = spark.createDataFrame([(c, i, "assistant", t) for c, ts in ((1, texts), (2, texts[::2])) for i, t in enumerate(ts)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.chat_format(frame).collect()}
    assert [t.text for t in got[1].turns] == texts and [t.text for t in got[2].turns] == texts[::2]
    assert got[1].escaped and not got[2].escaped
    assert [s.length for s in got[2].loss_spans] == [1_000_000, 5]
