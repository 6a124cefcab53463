"""The operators held against plain versions over small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlift.llm import bpe, exact_dedup, lang_id, line_dedup, lm_scoring, minhash, mixing, sharding, topk_search, url_filter
from ledgerlift.llm.sketching import sketch

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.rows(), brute.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (9, 0, 1), (9, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def pairs() -> list[tuple]:
    return [(r[0], r[1]) for r in brute.rows()]


def test_exact_dedup(docs, none):
    keep, size = brute.winners(pairs()), Counter(brute.bare(t) for _, t in pairs())
    got = exact_dedup.decide(docs).collect()
    want = Counter((i, keep[brute.bare(t)], size[brute.bare(t)], hashlib.sha256(brute.bare(t).encode()).hexdigest()) for i, t in pairs())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.doc_id for r in got if r.kept) == Counter(keep.values())
    left = exact_dedup.drop_duplicates(docs)
    assert left.schema == docs.schema and Counter(r.doc_id for r in left.collect()) == Counter(keep.values())
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_exact_dedup_of_a_large_group(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int"))).alias("text"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.decide(many, hot=8).collect()}
    texts = [(r.doc_id, r.text) for r in many.collect()]
    keep, size = brute.winners(texts), Counter(t.replace(" ", "") for _, t in texts)
    assert got == {i: (keep[brute.bare(t)], size[brute.bare(t)]) for i, t in texts}


def filled(sizes: list[int], weights: list[int], budget: float, most: int) -> list[float]:
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = budget / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] >= most * sizes[i]}
        for i in over or open_:
            target[i] = float(most * sizes[i]) if over else share * weights[i]
        budget -= sum(target[i] for i in over)
        open_ -= over or open_
    return target


def test_mixing(docs, labels, none):
    got = mixing.mix(docs, labels).collect()
    size = Counter()
    for r in brute.rows():
        size[r[3]] += len(brute.words(r[1]))
    order = sorted(s for s in size if s is not None) + [None]
    want = dict(zip(order, filled([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2), strict=True))
    taken = Counter()
    for r in got:
        assert r.size == len(brute.words(dict(pairs())[r.doc_id])) and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert len(got) == len(pairs()) and all(abs(taken[s] - want[s]) <= 1 for s in order)
    assert Counter(map(tuple, mixing.mix(docs.repartition(5), labels).collect())) == Counter(map(tuple, got))
    key = F.pow((F.col("id") + 0.5) / 40960, F.lit(2.0))  # quality weight 0.5: its keys crowd at nought
    held = docs.sparkSession.range(40960).groupBy(mixing.range_of(key).alias("r")).count()
    assert held.agg(F.max("count")).first()[0] <= 40960 / mixing.BUCKETS + 1
    whole = mixing.mixed(docs, labels)
    assert whole.columns == docs.columns and {r.doc_id for r in whole.collect()} <= {i for i, _ in pairs()}
    assert mixing.mix(none, labels).count() == 0 and mixing.mixed(none, labels).count() == 0


def test_line_dedup(spark, none):
    lines = ["the cat sat on the mat today again", "the cat sat on the mat today again ", "short line", "SHORT line", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59)), "", "quite another line of words that stands alone here"]
    given = [(1, "\n".join(lines[:3])), (2, "\n".join(lines[1:5])), (3, None), (4, ""), (5, "\n".join(lines[4:])), (6, "\n".join([lines[7], lines[0], lines[7]]))]
    seen: list[set] = []
    want = {}
    for i, text in given:
        gone = []
        for place, line in enumerate([] if text is None else text.split("\n")):
            own = brute.shingles(line)
            if any(brute.alike(own, s, 80) for s in seen):
                gone.append(place)
            if own:
                seen.append(own)
        want[i] = gone
    got = line_dedup.decide(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == want
    assert all(r.n_lines - len(r.removed) == r.kept_lines for r in got)
    assert line_dedup.decide(none).count() == 0
    left = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    for i, text in given:
        assert left[i] == (None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if k not in want[i]))


def test_line_dedup_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    seen: list[set] = []
    want = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        want[r.doc_id] = []
        for place, line in enumerate([] if r.text is None else r.text.split("\n")):
            own = brute.shingles(line)
            if any(brute.alike(own, s, 80) for s in seen):
                want[r.doc_id].append(place)
            if own:
                seen.append(own)
    assert {r.doc_id: r.removed for r in line_dedup.decide(docs).collect()} == want


def test_lm_scoring(docs, none):
    def tokens(t):
        return [*brute.words(t), None]

    trained = [(i, t) for i, t in pairs() if zlib.crc32(str(i).encode()) % 10]
    ones, twos = Counter(), Counter()
    for _, t in trained:
        own = tokens(t)
        ones.update(own)
        twos.update(zip([None, *own], own, strict=False))
    total, distinct = sum(ones.values()), len(ones)
    norm = total + 0.1 * (distinct + 1)
    middle = lambda c: 0 if c == 0 else 1 if c == 1 else 1.5 * 2 ** math.floor(math.log2(c)) - 0.5
    for bound in (lm_scoring.BROADCAST, 0):
        got = lm_scoring.score(docs, docs.where(lang_id.remainder(10) != 0), broadcast=bound, part=20_000, chunk=30_000).collect()
        assert len(got) == len(pairs())
        for r in got:
            own = tokens(dict(pairs())[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(ones[w] > 0 for w in own), total)
            assert r.base_score == pytest.approx(sum(math.log10((ones[w] + 0.1) / norm) for w in own))
            model = 0.0
            for a, b in zip([None, *own], own, strict=False):
                first = middle(ones[a])
                model += math.log10((min(middle(twos[a, b]), first) + 100 * (middle(ones[b]) + 0.1) / norm) / (first + 100))
            assert r.score == pytest.approx(model, rel=0.01)
    assert lm_scoring.score(none, none).count() == 0
    assert all(r.n_known == 0 for r in lm_scoring.score(docs, none).collect())


def test_bloom_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    keys, n = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)), rng.integers(1, 3000, 5000)
    level, own = lm_scoring.Filter.of(keys, n).levels(keys), np.floor(np.log2(n)) + 1
    assert (level >= own).all() and (level == own).mean() > 0.95
    assert (lm_scoring.Filter.of(keys, n).levels(keys ^ np.uint64(1)) > 0).mean() < 0.05


def test_lm_scores_do_not_depend_on_the_broadcast_bound(spark, docs):
    words_ = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(5000))))
    made = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.lit("seen often and again")).otherwise(F.array_join(words_, " ")).alias("text"))
    many = made.unionByName(docs.select("doc_id", "text"))
    training = many.where("doc_id % 10 <> 0")
    assert lm_scoring.part_bits(training, 100_000) > 2
    wide = sorted(lm_scoring.score(many, training, part=100_000).collect(), key=str)
    narrow = sorted(lm_scoring.score(many, training, broadcast=1000, part=100_000, chunk=100_000).collect(), key=str)
    assert len(wide) == len(narrow) == many.count()
    for a, b in zip(wide, narrow, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-12)


def test_sharding(docs, none):
    got = sharding.assign(docs, shards=5).collect()
    assert len(got) == len(pairs())
    held = Counter(r.shard for r in got)
    assert set(held) <= set(range(5)) and max(held.values()) - min(held[s] for s in range(5)) <= 1
    for s in held:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(held[s]))
    for r in got:
        t = (dict(pairs())[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
    assert sharding.assign(none).count() == 0


def test_sharding_gathers_equal_texts(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("g"), (F.col("id") / 40).cast("int"))).otherwise(F.col("id").cast("string")).alias("text"))
    spread = {}
    got = sharding.assign(many, shards=8).join(many, "doc_id").where("doc_id % 2 = 0").collect()
    for r in got:
        spread.setdefault(r.text, set()).add(r.shard)
    assert sum(map(len, spread.values())) / len(spread) < 1.5


@pytest.mark.parametrize("hot", [False, True])
def test_sharding_trades_between_full_shards(spark, hot):
    """With every document in a pair no shard has room to spare, and pairs still meet; a group of a third is in few shards."""
    pair = (F.col("id") / 2).cast("int").cast("string")
    text = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).otherwise((F.col("id") / 18).cast("int").cast("string")) if hot else pair
    many = spark.range(4800).select(F.col("id").alias("doc_id"), text.alias("text"))
    spread, counts = {}, Counter()
    for r in sharding.assign(many, shards=8).join(many, "doc_id").collect():
        counts[r.shard] += 1
        spread.setdefault(r.text, set()).add(r.shard)
    assert set(counts.values()) == {600}
    assert len(spread.pop("hot", ())) <= 5
    assert sum(map(len, spread.values())) / len(spread) < 1.1


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/page?x=1", "https://example.net/de/1", "http://sub.example.com/de/5#f", "http://example.com/en/5", "ftp://Some.ORG/fr/", "http://notexample.net.org/fr/x",
    "http://x.net", "http://anet/", "http://é.org/fr/ü", "a://b://c.net/d", "http://bad.biz/9", "http://good.info/8",
]


def test_url_filter(spark):
    outcomes = [(f"http://bad.biz/{i}", i) for i in range(100, 160)] + [(f"http://good.info/{i}", i) for i in range(200, 260)]
    every = [(None if i == 3 else i, u) for i, u in enumerate([*URLS, *[u for u, _ in outcomes]])]
    pages = spark.createDataFrame(every, "page_id long, url string").withColumns({"host": F.lit("clash"), "bound": F.lit(1), "mean": F.lit(2)})
    bad = spark.createDataFrame([(i, int(i < 200)) for _, i in outcomes] + [(None, 1)], "doc_id long, bad int")
    got = url_filter.judge(pages, bad).collect()
    assert len(got) == len(every)
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    seen = Counter()
    for _, u in every:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        rule = max(fit, key=len, default=None)
        own = "block" if host == "bad.biz" else "allow"
        seen[host, path, rule, rules.get(rule, own)] += 1
    assert Counter((r.host, r.path, r.rule, r.verdict) for r in got if r.host not in ("", "c.net")) == Counter({k: v for k, v in seen.items() if k[0] not in ("", "c.net")})
    assert all(r.rule is None for r in got if r.host == "")
    assert url_filter.judge(pages, bad.limit(0)).where("verdict = 'block' and rule is null").count() == 0
    assert url_filter.judge(pages.limit(0), bad).count() == 0


def plain_bounds(outcomes: dict[str, list[int]]) -> dict[str, float]:
    """The lower bound of each host's posterior, level by level."""
    def up(name: str, labels: int) -> str:
        return ".".join(name.split(".")[-labels:])

    two = {h: up(h, 2) in url_filter.SUFFIXES for h in outcomes}
    domain, suffix = {h: up(h, 3 if two[h] else 2) for h in outcomes}, {h: up(h, 2 if two[h] else 1) for h in outcomes}
    count = lambda keys: {k: (sum(len(v) for h, v in outcomes.items() if keys[h] == k), sum(sum(v) for h, v in outcomes.items() if keys[h] == k)) for k in set(keys.values())}
    every = [b for v in outcomes.values() for b in v]

    def posterior(level: dict, mean: dict) -> dict:
        seen = {k: nb for k, nb in level.items() if nb[0]}
        base = sum(mean[k] * (1 - mean[k]) for k in seen)
        slope = sum(mean[k] * (1 - mean[k]) * (n - 1) for k, (n, _) in seen.items())
        rho = (sum(n * (b / n - mean[k]) ** 2 for k, (n, b) in seen.items()) - base) / slope if slope > 0 else 0
        strength = min(url_filter.STRONGEST, max(url_filter.WEAKEST, 1 / rho - 1)) if rho > 0 else url_filter.STRONGEST
        return {k: (strength * mean[k] + b, strength * (1 - mean[k]) + n - b) for k, (n, b) in level.items()}

    share = lambda ab: ab[0] / (ab[0] + ab[1])
    top = (sum(every) + 0.5) / (len(every) + 1)
    suffixes = posterior(count(suffix), dict.fromkeys(suffix.values(), top))
    domains = posterior(count(domain), {domain[h]: share(suffixes[suffix[h]]) for h in outcomes})
    hosts = posterior({h: (len(v), sum(v)) for h, v in outcomes.items()}, {h: share(domains[domain[h]]) for h in outcomes})
    return {h: share((a, b)) - url_filter.SPARE * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) for h, (a, b) in hosts.items()}


def test_reputation_against_plain_shrinkage(spark):
    rng = np.random.default_rng(4)
    names = ["a.x.com", "b.x.com", "c.y.com", "y.com", "p.co.uk", "w.p.co.uk", "q.co.uk", "z.org", "", "lone", "empty.org"]
    outcomes = {h: rng.binomial(1, rng.uniform(), 0 if h == "empty.org" else rng.integers(1, 40)).tolist() for h in names}
    rows = [(h, b) for h, v in outcomes.items() for b in v] + [("empty.org", None), ("z.org", None)]
    got = {r.host: r.bound for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got == pytest.approx(plain_bounds(outcomes), rel=1e-9)


def test_topk(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 8)), 1).astype(np.float32)
    x[7] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [None] * 8), (450, [float("nan")] * 8), (460, [1.0] * 3), (7, x[7].tolist())]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)).repartition(4), every=50, k=5).collect()
    whole = [(i, np.floor(np.array(v, dtype=np.float64) * 256).astype(np.int64)) for i, v in rows[:300] + [rows[-1]]]
    want = set()
    for q, v in whole:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in whole if i != q)[:5]
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == 30
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_topk_leaves_the_lists_early():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(4000, 16)) / 4).astype(np.int64)
    ids, bar, shares = np.arange(4000), np.full(80, -np.inf), []
    found: dict[int, list] = {}
    for start, end in ((0, 256), (256, 1000), (1000, 4000)):
        rows, read = topk_search.aggregate(x[::50], ids[::50], x[start:end], ids[start:end], 5, bar)
        shares.append(read)
        for q, i, s in rows:
            found.setdefault(q, []).append((-s, i))
    assert all(sorted(found[q])[:5] == sorted((-int(x[q] @ x[i]), int(i)) for i in ids if i != q)[:5] for q in ids[::50])
    assert (shares[-1] < 1).mean() > 0.95 and shares[-1].mean() < 0.8


def test_topk_of_scores_beyond_doubles(spark):
    big = 1 << 40
    rows = [(i, [float(big + i), float(big - 3 * i)]) for i in range(12)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=4, k=3).collect()
    whole = [(i, [int(v * 256) for v in x]) for i, x in rows]
    want = set()
    for q, v in whole[::4]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:3]
        want |= {(q, r, i, min(-s, (1 << 63) - 1)) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want


def test_bpe(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()
    odd = ["<|endoftext|> in a text<|endoftext|>", "  spaces   \n\n\t x", "don't WE'LL 's ' s", "\u00a0\u2003漢字", "a\u0301 \x00 \x1c \x85 \u200b", "1²½ Ⅷ", "🙂🙂"]
    sample = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    every = sample.unionByName(docs.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    rows = every.collect()
    for size in (0, 300, 100_000):
        got = Counter(map(tuple, bpe.code(every, path, size).collect()))
        want = Counter()
        for r in rows:
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            text = tokenizer.decode(ids, skip_special_tokens=False)
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert got == want
    assert bpe.code(none, path).count() == 0
    assert {r.decoded for r in bpe.encode(docs, path).collect()} == {t or "" for _, t in pairs()}


def test_lexicon_is_an_exact_transducer():
    words = sorted({w.encode() for w in "a ab abc b bc tops taps top tap stop stops".split()})
    held = bpe.Lexicon(bpe.compile_lexicon(words, [[i, i + 1] for i in range(len(words))]))
    assert held.ranks(words).tolist() == list(range(len(words)))
    assert held.ranks([b"", b"to", b"topss", b"x"]).tolist() == [-1] * 4


def test_language_id(spark, docs, none):
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(sample.where(lang_id.remainder(3) != 1))
    judged = lang_id.predict(sample, model).join(sample.select("doc_id", "lang"), "doc_id").where((lang_id.remainder(3) == 1) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    right = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score"), F.max("score")).first()
    assert right.a >= 0.95 and 0 <= right[1] <= right[2] <= 1
    got = lang_id.predict(docs, model).collect()
    assert len(got) == len(pairs()) and {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 19}
    assert all(r.lang_pred == "und" and r.score == 0 for r in lang_id.predict(docs, lang_id.fit(none)).collect())
    assert lang_id.predict(none, model).count() == 0 and lang_id.keep_languages(docs, model, 0.5).schema == docs.schema


def test_ftrl_step_against_plain_arithmetic():
    """One document, one epoch from nothing: the gradient is that of even chances, and the weights follow from it alone."""
    x, y = np.array([0.5, 2.0, 1.0]), 1
    got = lang_id.ftrl(lambda i: (np.array([7, 9, lang_id.SIZE]), x), np.array([y]), 3, epochs=1)
    for slot, value in zip((7, 9, lang_id.SIZE), x, strict=True):
        for c in range(3):
            g = value * (1 / 3 - (c == y))
            z, n = g, g * g
            want = 0.0 if abs(z) <= lang_id.L1 else -(z - math.copysign(lang_id.L1, z)) / ((lang_id.BETA + math.sqrt(n)) / lang_id.ALPHA + lang_id.L2)
            assert got[slot, c] == pytest.approx(want)
    assert not got[[0, 8, 100]].any()


def test_temperature_minimises_the_loss():
    rng = np.random.default_rng(6)
    logits = 9 * rng.normal(size=(400, 4))
    y = np.array([rng.choice(4, p=lang_id.softmax(row / 3)) for row in logits])
    loss = lambda t: -np.log(lang_id.softmax(logits / t)[np.arange(400), y]).mean()
    t = lang_id.temperature(logits, y)
    assert 2 < t < 4.5 and all(loss(t) <= loss(t * f) + 1e-9 for f in (0.8, 0.95, 1.05, 1.25))


CLASH = "_id _n _size _from _times _words _copy _digest removed row given gone words copy size digest".split()


def test_rows_with_any_column_names(spark):
    """Names that the operators use inside, repeated rows and null doc_ids: all columns come back as they were."""
    base = [(1, "a b c d e f g h", "web"), (1, "a b c d e f g h", "web"), (2, "a b c d e f g h ", "web"), (None, "one two three four five six", None), (3, None, "web"), (4, "x y z\na b c d e f g h", "web")]
    docs = spark.createDataFrame([(*r, *[f"{i}-{c}" for c in CLASH]) for i, r in enumerate(base)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    known = {tuple(r) for r in docs.collect()}
    exact, near, mix, lines = exact_dedup.drop_duplicates(docs), minhash.keep_first(docs, 80), mixing.mixed(docs, labels), line_dedup.drop_lines(docs)
    for out in (exact, near, mix):
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= known
    assert Counter(r.doc_id for r in exact.collect()) == {2: 1, None: 1, 3: 1, 4: 1}
    assert Counter(r.doc_id for r in near.collect()) == {1: 2, None: 1, 3: 1, 4: 1}
    assert lines.columns == docs.columns
    assert Counter((r.doc_id, r.text, r._id.split("-")[0] if r.doc_id != 1 else None) for r in lines.collect()) == Counter({(1, "a b c d e f g h", None): 1, (1, "", None): 1, (2, "", "2"): 1, (None, base[3][1], "3"): 1, (3, None, "4"): 1, (4, "x y z", "5"): 1})


def test_line_links_grow_linearly(spark):
    """2000 lines that are all alike: one stays, and each other has few links."""
    word = lambda i, k: f"v{i}" if k == 59 else f"c{k}"
    docs = spark.createDataFrame([(i, " ".join(word(i, k) for k in range(60))) for i in range(2000)], "doc_id long, text string")
    lines = line_dedup.features(docs)
    found = line_dedup.links(docs, lines, line_dedup.class_heads(lines))
    assert 1999 <= found.count() <= 4000
    got = line_dedup.memberships(docs).collect()
    assert len(got) == 2000 and [r.doc_id for r in got if not r.gone] == [0] and all(r.match_doc_id == 0 for r in got if r.gone)


def test_components_of_long_chains_and_stars(spark):
    from ledgerlift.llm.components import components

    edges = [(i + 1, i) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1400)] + [(2000 - i, 2001 + i) for i in range(50)] + [(2001 + i, 1999 - i) for i in range(50)] + [(7, 7)]
    got = {r.x: r.root for r in components(spark.createDataFrame(edges, "x long, y long").repartition(7)).collect()}
    near: dict[int, set] = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y), near.setdefault(y, set()).add(x)
    want, seen = {}, set()
    for start in sorted(near):
        held = [start] if start not in seen else []
        while held:
            if (i := held.pop()) not in seen:
                seen.add(i)
                want[i] = start
                held += near[i]
    assert got == {i: r for i, r in want.items() if i != r}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1400, dtype=np.uint64)
    a, b, tiny = np.unique(pool[:1000]), np.unique(pool[400:]), np.unique(pool[:3])
    k = sketch([a, b, tiny], 128)
    assert abs((k[0] == k[1]).mean() - 600 / 1400) < 0.15 and (k != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(docs, none, percent):
    root = brute.components(pairs(), percent)
    got = minhash.link(docs, percent).collect()
    want = Counter((i, len(brute.shingles(t)), root[i], root[i] == i) for i, t in pairs())
    assert Counter(map(tuple, got)) == want
    assert minhash.link(none, percent).count() == 0 and minhash.keep_first(docs, percent).schema == docs.schema


def test_minhash_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root = brute.components([(r.doc_id, r.text) for r in docs.collect()], 85)
    assert {r.doc_id: r.component_id for r in minhash.link(docs, 85).collect()} == root
