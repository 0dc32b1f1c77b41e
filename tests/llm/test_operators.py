"""Each operator against brute force, an exact round trip or planted cases, and over awkward tables."""

import base64
import bisect
import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcorpus.llm import bpe, language_model, near_dedup, neighbours, packing, quality, secrets, sharding, suffix_dedup, token_counts, vocab
from loomcorpus.llm.common import pick
from loomcorpus.llm.words import _STRIP
from tests.llm.cases import COPY, LONG, ROWS, clashing, prose, rows_of, table

OPERATORS = {
    "packing": lambda df: packing.pack(df, 64),
    "quality": quality.clean_lines,
    "token_counts": token_counts.store,
    "suffix": suffix_dedup.repeated_spans,
    "lm": language_model.score,
    "near": near_dedup.near_groups,
    "bpe": bpe.encode,
    "sharding": lambda df: sharding.shard(df, 4096),
    "secrets": secrets.find_secrets,
    "cut": suffix_dedup.drop_repeats,
    "one": near_dedup.one_of_each,
    "mask": secrets.mask_secrets,
}


@pytest.fixture(scope="module")
def encoder():
    return vocab.encoding(vocab.vocabulary_path())


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, name):
    f = OPERATORS[name]
    assert f(table(spark, [])).collect() == []
    plain = rows_of(f(table(spark)))
    assert rows_of(f(clashing(spark))) == plain
    nulls = [(None, None, None, None, None)] * 3
    f(table(spark, nulls)).collect()
    if name in ("quality", "token_counts", "bpe", "sharding", "lm", "cut", "mask"):
        assert len(plain) == len(ROWS)


def test_fullest_bins_by_brute_force():
    r = random.Random(5)
    for _ in range(150):
        cap = r.randint(5, 30)
        items = [r.randint(1, cap) for _ in range(r.randint(1, 9))]
        counts = Counter(items)
        chosen = packing.fullest(sorted(counts, reverse=True), counts, cap)
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= cap)
        assert sum(a * n for a, n in chosen) == best
        assert all(n <= counts[a] for a, n in chosen)
        bins = packing.plan(dict(counts), cap)
        assert sum((Counter({a: n * t for a, n in c}) for t, c in bins), Counter()) == counts


def test_packing_places_every_token_once(spark, encoder):
    rows = packing.pack(table(spark), 64).collect()
    used, got = defaultdict(list), defaultdict(list)
    for r in rows:
        used[r.bin_id].append((r.bin_offset, r.bin_offset + r.n_tokens))
        got[r.doc_id].append((r.start, r.start + r.n_tokens))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for i, text, *_ in ROWS:
        n = len(encoder.encode_ordinary(text)) if text else 0
        spans = sorted(set(got.get(i, [])))
        assert sum(b - a for a, b in spans) == n
    fullest = -(-sum(b - a for s in used.values() for a, b in s) // 64)
    assert len(used) <= 1.05 * fullest + 1


@pytest.mark.parametrize("bucket", [packing.BUCKET, 2])
def test_pieces_of_a_length_in_many_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    rows = [(i, "one two three four", "", "", 0) for i in range(50)] + [(i, "one two", "", "", 0) for i in range(50, 70)]
    out = packing.pack(table(spark, rows), 10).collect()
    assert sorted(r.doc_id for r in out) == list(range(70))
    used = defaultdict(list)
    for r in out:
        used[r.bin_id].append((r.bin_offset, r.bin_offset + r.n_tokens))
    assert all(a[1] == b[0] for s in used.values() for a, b in zip(sorted(s), sorted(s)[1:])) and all(max(s)[1] <= 10 for s in used.values())
    assert len(used) == 25  # 20 of 4 + 4 + 2, 5 of 4 + 4


@pytest.mark.parametrize(
    "line, fault",
    [
        ("Home | About | News | Contact.", "navigation"),
        ("All rights reserved.", "boilerplate"),
        ("no end of a sentence", "punctuation"),
        ("*** $$$ ### %%% ends.", "punctuation"),
        ("la la la la la la la la end.", "boilerplate"),
        ("A plain sentence. And one more", ""),
        ('He said "so."', ""),
        ("Er sagte: „So ist es.“", ""),
        ("« Oui.\u00a0»", ""),
        ("Ends here.))))))))))))", ""),
        ("यह पहला वाक्य है।", ""),
        ("هل هذا سؤال؟", ""),
        ("这是一个句子。还有一个", ""),
        ("ประเทศไทยเป็นประเทศที่มีวัฒนธรรมยาวนานมาก", ""),
        ("Alle Rechte vorbehalten.", "boilerplate"),
    ],
)
def test_line_rules(spark, line, fault):
    df = spark.createDataFrame([(line,)], "x string")
    assert df.select(quality.line_fault(F.col("x")).alias("f")).first().f == fault


def test_documents_that_lose_too_much_go(spark):
    good = "This is a fine sentence.\n"
    rows = [(1, good * 5, "", "", 0), (2, good + "menu | menu | menu | menu\n" * 9, "", "", 0), (3, good * 5 + "click here\n", "", "", 0)]
    got = {r.doc_id: r for r in quality.clean_lines(table(spark, rows)).collect()}
    assert [got[i].keep for i in (1, 2, 3)] == [True, False, True]
    assert got[3].text == (good * 5).strip() and got[3].boilerplate == 1


def test_every_prefix_is_counted(spark, encoder):
    texts = ["Hello  world's   end\n\n\n x", "we'll they're 'r don't''ve", "  \t lead", "naïve 漢字 \U0001f600!", "aaaa" * 30, "a" * 700, COPY[:300], " ", ""]
    stored = token_counts.store(table(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]), 5)
    for r in stored.collect():
        text = texts[r.doc_id]
        want = [len(encoder.encode_ordinary(text[: k + 1])) for k in range(len(text))]
        got = token_counts.counts_of(r.changes, r.width).tolist()
        wrong = [(k, text[: k + 1][-12:]) for k in range(len(text)) if got[k] != want[k]]
        assert not wrong
        assert r.cut == max([k + 1 for k, n in enumerate(want) if n <= 5], default=0)
        assert r.n_tokens == len(encoder.encode_ordinary(text))
    for r in token_counts.tokens_at(stored, 4).collect():
        assert r.tokens == len(encoder.encode_ordinary(texts[r.doc_id][:4]))
    assert {r.doc_id: r.chars for r in token_counts.cut_at(stored, 5).collect()} == {r.doc_id: r.cut for r in stored.collect()}


def test_answers_over_awkward_tables(spark):
    for df in (table(spark), clashing(spark)):
        stored = token_counts.store(df, 5).select("*", F.lit(1).alias("CHANGES"))
        lengths = {i: len(t or "") for i, t, *_ in ROWS}
        for f, zero in ((lambda s: token_counts.tokens_at(s, 3), "tokens"), (lambda s: token_counts.cut_at(s, 5), "chars"), (lambda s: token_counts.tokens_at(s, 0), "tokens")):
            got = f(stored).collect()
            assert len(got) == len(ROWS) and all(r[zero] == 0 for r in got if not lengths[r.doc_id])
            assert f(stored.limit(0)).collect() == []
        encoded = bpe.encode(df).select("*", F.lit("x").alias("Tokens"), F.lit(1).alias("extra"))
        assert Counter((r.doc_id, r.text) for r in bpe.decode(encoded).collect()) == Counter((i, t) for i, t, *_ in ROWS)
        assert bpe.decode(encoded.limit(0)).collect() == []


def _repeats(texts, k):
    seen = defaultdict(list)
    for d, t in sorted(texts.items()):
        w = t.split()
        for i in range(len(w) - k + 1):
            seen[tuple(w[i : i + k])].append((d, i))
    marks = {(False, p) for v in seen.values() if len(v) > 1 for p in v} | {(True, p) for v in seen.values() for p in v[1:]}
    spans = set()
    for later in (False, True):
        for d in texts:
            at = sorted(i for f, (e, i) in marks if f == later and e == d)
            while at:
                n = 1
                while n < len(at) and at[n] <= at[n - 1] + k:
                    n += 1
                spans.add((d, later, at[0], at[n - 1] + k))
                at = at[n:]
    return spans


def test_a_passage_in_many_different_documents(spark):
    """Its runs are counted: no task of merging gets them."""
    passage = prose(6, 55)
    texts = {i: " ".join([f"a{i}x{j}" for j in range(60)] + [passage] + [f"b{i}x{j}" for j in range(60)]) for i in range(1500)}
    df = table(spark, [(i, t, "", "", 0) for i, t in texts.items()])
    got = suffix_dedup.repeated_spans(df, hot_pieces=1000).select("doc_id", "later", "start", "stop").collect()
    assert {tuple(x) for x in got} == {(i, later, 60, 115) for i in texts for later in (False, True) if i or not later}


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeated_passages_by_brute_force(spark, hot):
    r = random.Random(7)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("abcdefghijklmnop")
    shared = [[word() for _ in range(r.randint(8, 40))] for _ in range(6)]
    texts = {}
    for d in range(60):
        w = [word() for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, len(p) // 3)
            w += p[a : len(p) - r.randint(0, len(p) // 3)] + [word() for _ in range(r.randint(0, 9))]
        texts[d] = " ".join(w)
    texts[60] = "x " * 50
    texts[61] = texts[3]
    df = table(spark, [(d, t, "", "", 0) for d, t in texts.items()])
    got = suffix_dedup.repeated_spans(df, words=10, gram=3, bucket_words=500, hot_pieces=hot).select("doc_id", "later", "start", "stop").collect()
    assert {tuple(x) for x in got} == _repeats(texts, 10)


def test_interleave_merges_like_sorting_all_suffixes():
    r = np.random.default_rng(3)
    items = [r.integers(1, 4, r.integers(1, 12)).astype(np.uint64) for _ in range(30)]
    bwts, sizes = [], []
    for part in (items[:7], items[7:8], items[8:]):
        sym = np.concatenate([np.append(x, np.uint64(0)) for x in part])
        item = np.repeat(np.arange(len(part)), [len(x) + 1 for x in part])
        bwts.append(suffix_dedup.transform(sym, item, np.zeros(len(part), int))[1])
        sizes.append(len(part))
    rows, common, _ = suffix_dedup.interleave(bwts, sizes, 20)
    every = sorted((x[i:].tolist() + [0], j) for j, x in enumerate(items) for i in range(len(x) + 1))
    lcp = [0]
    for (a, _), (b, _) in zip(every, every[1:]):
        n = 0
        while n < min(len(a), len(b)) - 1 and a[n] == b[n] != 0:
            n += 1
        lcp.append(n)
    assert common.tolist() == lcp
    assert len(set(rows.tolist())) == len(every)


def test_passages_are_cut_but_first_copies_stay(spark):
    out = {r.doc_id: r for r in suffix_dedup.drop_repeats(table(spark)).collect() if r.doc_id is not None}
    assert out[1].text == COPY and out[2].text == "" and out[12].text == dict((r[0], r[1]) for r in ROWS)[12]
    assert out[3].text.strip() == prose(3, 80) and out[3].n_chars == len(out[3].text)
    assert out[8].text == LONG and out[4].text is None and out[5].text == ""


def _check_neighbours(x, rows, every, least):
    x = x.astype(np.float32).astype(np.float64)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    asked = range(0, len(x), every)
    want = {i: np.lexsort((np.arange(len(x)), d[i]))[:10].tolist() for i in asked}
    got = defaultdict(dict)
    for q in rows:
        got[q.vec_id][q.rank] = q.neighbour_id
        assert abs(q.distance**2 - d[q.vec_id, q.neighbour_id]) < 1e-6
    assert all(sorted(v) == list(range(1, 11)) for v in got.values()) and set(got) == set(asked)
    assert np.mean([len(set(want[i]) & set(got[i].values())) / 10 for i in asked]) >= least
    return want, got


@pytest.mark.parametrize("every, block", [(1, 64), (7, 1 << 16)])
def test_neighbours_by_brute_force(spark, every, block):
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((1500, 24)), r.standard_normal((8, 24)).repeat(60, axis=0) + 0.05 * r.standard_normal((480, 24))])
    x[10] = x[11]
    x[20] = 0
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    _, got = _check_neighbours(x, neighbours.nearest(df, cell=400, leaf=32, every=every, query_block=block).collect(), every, 0.9)
    assert every > 1 or got[10][1] == 11
    # a trunk of two cells over few samples, so that cells are divided by hash
    _check_neighbours(x, neighbours.nearest(df, cell=100, leaf=16, every=13, sample=20).collect(), 13, 0.9)


def test_equal_vectors_go_by_id_however_many(spark):
    x = np.random.default_rng(2).standard_normal((700, 8))
    x[100:250] = x[100]
    x[600:] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(5)
    want, got = _check_neighbours(x, neighbours.nearest(df, cell=100, leaf=16, every=1).collect(), 1, 0.9)
    for i in [0, *range(100, 250), *range(600, 700)]:
        assert [got[i][k] for k in range(1, 11)] == want[i]


def test_neighbours_of_awkward_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, LABEL int, Embedding string"
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [0.0, 1.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], schema)
    got = {(r.vec_id, r.neighbour_id) for r in neighbours.nearest(df, every=1).collect()}
    assert got == {(a, b) for a in (1, 2, 8) for b in (1, 2, 8) if a != b}
    assert {r.vec_id for r in neighbours.nearest(df, every=4).collect()} == {8}
    assert neighbours.nearest(df.limit(0)).collect() == []
    assert neighbours.nearest(df.filter("vec_id = 1"), every=1).collect() == []


def _scores(rows, held, encoder, rounds):
    """log_prob of every (id, text) row by the counts of all others, one token after the other."""
    size = encoder.max_token_value + 1
    grams = [list(zip([size, *t[:-1]], t)) for _, x in rows for t in [encoder.encode_ordinary(x)]]

    def counts(some):
        c2 = Counter(g for gs in some for g in gs)
        c1, cc = Counter(), Counter()
        for (a, b), n in c2.items():
            c1[b] += n
            cc[a] += n
        return c2, c1, cc, sum(c1.values())

    def parts(g, m):
        c2, c1, cc, total = m
        return [c2[g] / cc[g[0]] if cc[g[0]] else 0, c1[g[1]] / total if total else 0, 1 / size]

    trained = counts([gs for gs, (i, _) in zip(grams, rows) if i not in held])
    heldout = Counter(g for gs, (i, _) in zip(grams, rows) if i in held for g in gs)
    w = defaultdict(lambda: [1 / 3] * 3)
    for _ in range(rounds):
        sums = defaultdict(lambda: [0.0] * 3)
        for g, n in heldout.items():
            b = trained[2][g[0]].bit_length()
            s = [x * p for x, p in zip(w[b], parts(g, trained))]
            for j in range(3):
                sums[b][j] += n * s[j] / sum(s)
        for b, s in sums.items():
            s = [max(x / sum(s), language_model.LEAST) for x in s]
            w[b] = [x / sum(s) for x in s]
    out = []
    for j in range(len(rows)):
        m = counts(grams[:j] + grams[j + 1 :])
        total = 0.0
        for g in grams[j]:
            k = list(w[m[2][g[0]].bit_length()])
            k = [k[0] * (m[2][g[0]] > 0), k[1] * (m[3] > 0), k[2]]
            total += math.log(sum(x * p for x, p in zip(k, parts(g, m))) / sum(k))
        out.append(total)
    return out


@pytest.mark.parametrize("sent", [10**6, 0])
def test_language_model_by_brute_force(spark, encoder, monkeypatch, sent):
    rows = [(i, prose(100 + i % 7, 40 + i)) for i in range(40)] + [(3, prose(103, 43)), (50, "only here, once")]
    df = table(spark, [(i, t, "", "", 0) for i, t in rows])
    held = {r.doc_id for r in df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).collect()}
    monkeypatch.setattr(language_model, "SETTLED", -1)
    got = sorted((r.doc_id, r.log_prob) for r in language_model.score(df, held_out=4, rounds=5, sent_bigrams=sent).collect())
    want = sorted((i, p) for (i, _), p in zip(rows, _scores(rows, held, encoder, 5)))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for (_, a), (_, b) in zip(got, want))


def test_the_only_text_is_new_to_the_model(spark, encoder):
    r = language_model.score(table(spark, [(1, "a b c", "", "", 0)])).first()
    assert abs(r.perplexity - (encoder.max_token_value + 1)) < 1e-3


def test_ids_beyond_16_bits(spark, tmp_path, encoder):
    v = vocab.load(vocab.vocabulary_path())
    ranks = dict(v.ranks)
    for a, b in itertools.product(range(300, 20_000, 61), range(256, 20_000, 67)):
        token = v.tokens[a] + v.tokens[b]
        if token not in ranks and len(ranks) < 66_000 and v.merge(token) == [a, b]:
            ranks[token] = len(ranks)
    assert len(ranks) == 66_000
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % n for t, n in ranks.items()))
    wide = vocab.encoding(str(path))
    texts = [COPY, "".join(x.decode("utf-8", "ignore") for x in list(ranks)[65_550:65_900]), "a b"]
    df = table(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r.tokens for r in bpe.encode(df, str(path)).collect()}
    assert all(got[i] == wide.encode_ordinary(t) for i, t in enumerate(texts)) and max(got[1]) > 1 << 16
    for r in token_counts.store(df, 5, str(path)).collect():
        some = texts[r.doc_id][:300]
        assert token_counts.counts_of(r.changes, r.width).tolist()[: len(some)] == [len(wide.encode_ordinary(some[: k + 1])) for k in range(len(some))]
    want = _scores(list(enumerate(texts)), {r.doc_id for r in df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).collect()}, wide, 3)
    for sent in (10**6, 0):
        got = {r.doc_id: r.log_prob for r in language_model.score(df, str(path), 2, 3, sent).collect()}
        assert all(abs(got[i] - p) < 1e-3 * abs(p) for i, p in enumerate(want))


def _overlap(a, b, k=near_dedup.SHINGLE):
    def bag(t):
        w = [x.lower().strip(_STRIP) or x for x in t.split()]
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)])

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def _groups(texts, near):
    """Label of each id when all pairs that are near are connected."""
    label = {i: i for i in texts}
    for a, b in itertools.combinations(texts, 2):
        if near(a, b):
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    return label


def _check_groups(rows, texts, near):
    label = _groups(texts, near)
    sizes, copies = Counter(label.values()), {i: sum(t == u for u in texts.values()) for i, t in texts.items()}
    assert {(x.doc_id, x.group_id, x.keep, x.copies) for x in rows} == {(i, g, i == g, copies[i]) for i, g in label.items() if sizes[g] > 1}
    assert all(x.links or x.copies > 1 for x in rows)
    return label


#: The ways of small sets, and those of large ones: joins, blocks of a bucket, labels passed along edges.
SMALL, LARGE = {}, {"SENT_IDS": 0, "SENT_EDGES": 0, "TOGETHER": 3}


@pytest.mark.parametrize("bounds", [SMALL, LARGE])
def test_near_duplicates_by_brute_force(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(near_dedup, k, v)
    r = random.Random(11)
    texts = {}
    for g in range(12):
        base = prose(500 + g, r.randint(30, 200)).split()
        texts[len(texts)] = " ".join(base)
        for _ in range(r.randint(0, 4)):
            w = base[:]
            for _ in range(len(w) // 40):
                w[r.randrange(len(w))] = "changed"
            texts[len(texts)] = " ".join(w)
    for i in range(25):
        texts[len(texts)] = prose(900 + i, 60)
    df = table(spark, [(i, t, "", "", 0) for i, t in texts.items()])
    label = _check_groups(near_dedup.near_groups(df, block=2 if bounds else near_dedup.BLOCK).collect(), texts, lambda a, b: _overlap(texts[a], texts[b]) >= near_dedup.OVERLAP)
    kept = {x.doc_id for x in near_dedup.one_of_each(df).collect()}
    assert kept == set(label.values())
    upper = table(spark, [(i, t.upper(), "", "", 0) for i, t in texts.items()])
    assert {x.doc_id for x in near_dedup.one_of_each(upper).collect()} == kept


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 3])
def test_originals_with_the_largest_id_join_their_copies(spark, block):
    r = random.Random(23)
    texts = {}
    for g in range(40):
        base = prose(1500 + g, 150).split()
        for share in (0.07, 0.08, 0.09, 0.1):  # about 0.6 of the original's shingles each, of each other's less than half
            w = base[:]
            for i in r.sample(range(len(w)), int(len(w) * share)):
                w[i] = f"edit{len(texts)}x{i}"
            texts[len(texts)] = " ".join(w)
        texts[1000 + g] = " ".join(base)
    df = table(spark, [(i, t, "", "", 0) for i, t in texts.items()])
    signed = {x.doc_id: x for x in near_dedup.banded(df).collect()}

    def near(a, b):
        x, y = signed[a], signed[b]
        same = (np.frombuffer(x.sig, np.uint16) == np.frombuffer(y.sig, np.uint16)).sum()
        return same >= near_dedup.AGREE and set(x.bands) & set(y.bands) and _overlap(texts[a], texts[b]) >= near_dedup.OVERLAP

    _check_groups(near_dedup.near_groups(df, block=block).collect(), texts, near)


def test_texts_of_one_template_are_no_copies(spark):
    core = prose(77, 60)
    texts = {i: core + " " + prose(3000 + i, 70) for i in range(300)}
    texts[300] = core + " " + prose(3005, 70) + " more."
    got = near_dedup.near_groups(table(spark, [(i, t, "", "", 0) for i, t in texts.items()]), block=50).collect()
    assert {(x.doc_id, x.group_id, x.links) for x in got} == {(5, 5, 1), (300, 5, 1)}


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    a = r.integers(1, 40, 60)
    b = np.maximum(1, a + r.integers(-15, 15, 60))
    n = 60
    text = np.repeat([0, 1], n)
    shingle = np.tile(np.arange(n), 2).astype(np.uint64)
    sig = near_dedup.signatures(text, shingle, np.concatenate([a, b]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_one_row_of_each_id_stays(spark):
    out = near_dedup.one_of_each(table(spark)).collect()
    ids = Counter(r.doc_id for r in out)
    assert ids[9] == 1 and ids[1] == 1 and 2 not in ids and ids[None] == 1 and ids[4] == ids[5] == ids[6] == 1


def test_bpe_matches_the_reference_encoder(spark, encoder):
    texts = [t for _, t, *_ in ROWS if t] + ["x" * 3000, "'s're", "\r\n\t  a", "퟿"]
    enc = bpe.Encoder(vocab.vocabulary_path())
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == encoder.encode_ordinary(t)
    encoded = bpe.encode(table(spark))
    assert all(r.same for r in encoded.collect() if r.tokens is not None)
    back = {r.doc_id: r.text for r in bpe.decode(encoded.filter("doc_id is not null")).collect()}
    assert back == {i: t for i, t, *_ in ROWS if i is not None}


def test_pairs_are_checked_alike_one_by_one_and_at_once():
    v = vocab.load(vocab.vocabulary_path())
    r = np.random.default_rng(0)
    a, b = r.integers(0, v.size, 3000), r.integers(0, v.size, 3000)
    assert v.compatible(a, b).tolist() == [v.valid(int(x), int(y)) for x, y in zip(a, b)]


def _shards(rows, target):
    """Placement by the method, one row after the other."""
    weigh = lambda r: len((r[1] or "").encode()) + sharding.RECORD_BYTES
    step = max(1, target // sharding.SAMPLES_PER_SHARD)
    hits = Counter()
    for r in rows:
        w = weigh(r)
        offset = int(hashlib.md5(f"{'null' if r[0] is None else r[0]}|{w}".encode()).hexdigest()[:12], 16) % step
        hits[(r[3] or "", -1 if r[0] is None else r[0])] += (w + offset) // step
    h, ranges = sum(hits.values()), max(1, -(-sum(map(weigh, rows)) // target))
    cuts, upto = [], 0
    for key in sorted(k for k in hits if hits[k]):
        before, upto = upto, upto + hits[key]
        if before * ranges // h < upto * ranges // h and upto < h:
            cuts.append(key)
    at = defaultdict(list)
    for r in rows:
        key = (r[3] or "", -1 if r[0] is None else r[0])
        at[bisect.bisect_left(cuts, key)].append((key, weigh(r), r[0] is None, r[0]))
    out = Counter()
    for i, some in at.items():
        whole, before = sum(x[1] for x in some), 0
        for _, w, _, d in sorted(some, key=lambda x: x[:3]):
            out[(d, i, before // target if whole > int(sharding.OVERFULL * target) else 0, w)] += 1
            before += w
    return out


@pytest.mark.parametrize("level, rows_a_task", [(sharding.LEVEL, sharding.SORTED_ROWS), (3, 40)])
def test_shards_by_brute_force(spark, level, rows_a_task):
    rows = [(i, "x" * (17 * i % 3000), "", f"s{i % 3}", 0) for i in range(600)]
    rows += [(7, "same", "", "s1", 0)] * 400 + [(None, "y" * 50, "", None, 0)] * 9 + [(-1, "y" * 50, "", None, 0)] * 9 + [(800, "z" * 90_000, "", "s2", 0), (801, None, "", "s2", 0)]
    got = Counter(tuple(r) for r in sharding.shard(table(spark, rows), 20_000, level=level, rows=rows_a_task).collect())
    assert got == _shards(rows, 20_000)
    assert len({r[1] for r in got}) > 20 and max(r[2] for r in got) > 0
    size = Counter()
    for (_, i, part, w), n in got.items():
        size[(i, part)] += n * w
    assert max(v for k, v in size.items() if v < 90_000) <= sharding.OVERFULL * 20_000 + 3100


def test_shards_are_written(spark, tmp_path):
    rows = [(i, "x" * (17 * i % 3000), "en", f"s{i % 3}", 0) for i in range(300)] + [(7, "same", "en", "s1", 0)] * 200
    sharding.write_shards(table(spark, rows), str(tmp_path / "s"), target=9_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(tuple(r) for r in back.select("doc_id", "text", "lang", "source", "n_chars").collect()) == Counter(rows)
    assert Counter((r.doc_id, r.range_id, r.part) for r in back.collect()) == Counter(k[:3] for k in _shards(rows, 9_000).elements())


def test_secrets(spark):
    r = random.Random(3)
    rand = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    planted = [rand(n) for n in (20, 24, 32, 40, 44)]
    clean = ["d41d8cd98f00b204e9800998ecf8427e", "550e8400-e29b-41d4-a716-446655440000", "internationalization", "some-kebab-case-identifier-name", "1234567890123456", "camelCaseIdentifierName2"]
    rows = [(i, f"text before {s} and after.", "", "", 0) for i, s in enumerate([*planted, *clean])]
    found = secrets.find_secrets(table(spark, rows)).collect()
    assert {(x.doc_id, x.secret) for x in found} == set(enumerate(planted))
    assert all(rows[x.doc_id][1][x.start : x.stop] == x.secret for x in found)
    masked = {x.doc_id: x for x in secrets.mask_secrets(table(spark, rows)).collect()}
    assert all(("[SECRET]" in masked[i].text) == (i < len(planted)) for i in masked)


def _naive_tokens(word: bytes, ranks) -> int:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        r, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if r == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts)


def _all_substrings(text, ranks, splitter):
    """Every substring that is a secret by the rules, tried one by one."""
    allowed = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")
    beside = lambda c: c.isalnum() or c in "_+/-"
    found = []
    for i in range(len(text)):
        if text[i] not in allowed or i and beside(text[i - 1]):
            continue
        for j in range(i + secrets.MIN_CHARS, len(text) + 1):
            body = text[i:j].rstrip("=")
            pad = j - i - len(body)
            if not set(body) <= allowed or pad > 2 or len(body) < secrets.MIN_CHARS:
                continue
            if j < len(text) and (beside(text[j]) or text[j] == "="):
                continue
            named = bool(secrets.CREDENTIAL.search(text[max(0, i - 48) : i]))
            n = sum(_naive_tokens(w.encode(), ranks) for w in splitter.findall(text[i:j]))
            if not secrets.excluded(text[i:j], named) and (j - i) / n <= secrets.MAX_RATIO:
                found.append((i, j, text[i:j], n, named))
    return found


def test_secrets_by_brute_force(spark):
    r = random.Random(31)
    v = vocab.load(vocab.vocabulary_path())
    chars = "abcXYZ019+/_-=="
    bits = ["key=", "token: ", " ", "\n", '"', "é", "=", "a-b-c", "secret_key = ", "?t=", "d41d8cd98f00b204e9800998ecf8427e", "some-kebab-case-name", "550e8400-e29b-41d4-a716-446655440000"]
    make = lambda: "".join(r.choice(bits) if r.random() < 0.5 else "".join(r.choice(chars if r.random() < 0.5 else "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(3, 40))) for _ in range(r.randint(1, 9)))
    texts = {i: make() for i in range(250)}
    want = {(i, *x) for i, t in texts.items() for x in _all_substrings(t, v.ranks, v.splitter)}
    df = table(spark, [(i, t, "", "", 0) for i, t in texts.items()])
    got = {(x.doc_id, x.start, x.stop, x.secret, x.n_tokens, x.named) for x in secrets.find_secrets(df).collect()}
    assert got == want and len(want) > 60
    for x in secrets.mask_secrets(df).collect():
        t = texts[x.doc_id]
        for _, i, j, *_ in sorted((y for y in want if y[0] == x.doc_id), reverse=True):
            t = t[:i] + "[SECRET]" + t[j:]
        assert x.text == t


def test_secrets_directly_after_an_assignment_sign(encoder):
    count = lambda s: len(encoder.encode_ordinary(s))
    secret = "q7Xk2LmP9vRt4WzB8nYc3DfG6hJs"
    for form in ("api_key={}", "AWS_SECRET_ACCESS_KEY={}\nNEXT=1", "https://example.org/a?x=1&token={}&y=2", "KEY={}", 'KEY="{}"', "see ?token={}."):
        text = form.format(secret)
        assert [(x[0], x[2]) for x in secrets.scan_text(text, count)] == [(text.index(secret), secret)], form
    for clean in ("file=some-kebab-case-identifier-name", "md5=d41d8cd98f00b204e9800998ecf8427e", "id=550e8400-e29b-41d4-a716-446655440000", "=" * 40):
        assert secrets.scan_text(clean, count) == [], clean


def test_keys_of_a_digest_length_count_where_they_are_named(encoder):
    count = lambda s: len(encoder.encode_ordinary(s))
    r = random.Random(8)
    for name in ("secret_key", "SECRET KEY", "auth_key", "encryption_key", "auth-id", "client_secret_value", "secret", "auth"):
        for n in (32, 40, 64):
            key = "".join(r.choice("0123456789abcdef") for _ in range(n))
            found = secrets.scan_text(f'{name} = "{key}"', count)
            assert [(x[2], x[5]) for x in found] == [(key, True)], name
            assert secrets.scan_text(f'checksum = "{key}"', count) == []


def test_pick_prefers_the_exact_name(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, Text string, text string")
    assert tuple(pick(df, "doc_id", "text").first()) == (1, "b")
