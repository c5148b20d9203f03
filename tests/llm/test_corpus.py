"""Operators over the whole corpus: lines, near duplicates, mixing, sharding, language model; and the pipeline."""

import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import jaccard, lines, links, lm, mixing, sharding


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 9), (20, 20)]
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bayesian_bounds():
    for k, m in jaccard.least_matches(0.8, 1e-6):
        tail = sum(math.comb(k + 1, i) * 0.8 ** i * 0.2 ** (k + 1 - i) for i in range(m + 1))
        assert tail >= 1e-6 > tail - math.comb(k + 1, m) * 0.8 ** m * 0.2 ** (k + 1 - m)


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = {i: [j for j in sets if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    group = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = group[i] if i in group else i
                todo += near[x]
    return {i: (group[i], len(near[i])) for i in sets}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)          # so that groups span several blocks
    rng = random.Random(5)
    rows = []
    for base in range(6):
        words = [rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz") for _ in range(70)]
        for _ in range(9):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(70)] = "changed"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, "tiny text"), (101, "Tiny, text!"), (102, ""), (103, None), (104, "...")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["group_id"], r["n_links"]) for r in got} == brute_links(rows)


def test_near_duplicates_odd_rows(spark, odd, none):
    kept = jaccard.one_of_each(spark, odd, "")
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 0 and ids[None] == 2 and ids[4] == ids[5] == ids[7] == 1
    assert jaccard.similar_groups(none).count() == 0 and jaccard.one_of_each(spark, none, "").count() == 0


def test_shard_in_superblocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SUPERBLOCKS", 3)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 40)
    df = spark.range(1003).select("id", F.create_map(F.lit("k"), "id").alias("held"), F.lit(None).cast("string").alias("block"))
    rows = sharding.shard(df, 7).collect()
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    assert len({r["id"] for r in rows}) == 1003 and all(r["held"] == {"k": r["id"]} for r in rows)
    assert sorted(map(len, per.values())) == [143] * 5 + [144] * 2 and all(sorted(x) == list(range(len(x))) for x in per.values())
    again = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard(df.repartition(5), 7).collect()}
    assert again == {r["id"]: (r["shard"], r["slot"]) for r in rows}
    cuts = sharding.block_cuts(spark.createDataFrame([(b, 40 + b) for b in range(11)], "block int, n long"), 495, 7, 1).collect()
    assert sorted((r["block"], r["cuts"][-1]) for r in cuts) == [(b, 40 + b) for b in range(11)]
    assert sum(r["cuts"][0] for r in cuts) == 71


def test_near_duplicates_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(["one two three four five six"] * 3 + ["", None])],
                               "doc_id long, text string, extra_id long, extra_mark long")
    kept = jaccard.one_of_each(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4]


def test_lines(spark, odd, none):
    base = " ".join(f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("an", "el", "in", "or", "ut", "am", "ex", "is", "ol", "up", "ad", "en", "it", "os", "un"))
    near = base.replace("aan", "eleven")
    rows = [(1, f"{base}\nunique one"), (2, f"{near.upper()}!\n\n--\nunique two"), (3, f"unique one\n{base}"), (4, None), (5, "")]
    out = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert got == {1: (f"{base}\nunique one", 2, 0), 2: ("\n--\nunique two", 4, 1), 3: ("", 2, 2), 4: (None, 0, 0), 5: ("", 1, 0)}
    whole = lines.deduplicate_lines(odd)
    assert whole.columns == [*odd.columns, "n_lines", "n_removed"] and whole.count() == 12
    assert lines.deduplicate_lines(none).count() == 0


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_links_against_brute_force(spark):
    """Every link is right, and of the pairs with one changed word nearly all are found."""
    rng = random.Random(1)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(2000)]
    texts, made = [], []
    for n in (8, 12, 20, 30, 50):
        for _ in range(40):
            w = rng.choices(words, k=n)
            j = rng.randrange(n)
            x = rng.randrange(len(w[j]))
            texts += [" ".join(w), " ".join([*w[:j], w[j][:x] + "é" + w[j][x + 1:], *w[j + 1:]])]
            made.append((n, len(texts) - 2, len(texts) - 1))
    texts += [texts[0] + f" {c}" for c in "abcdefgh"] + ["x", "y", "a b", "a c"]      # a group in one bucket; lines too short
    distinct = lines.distinct_lines(lines.line_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                                                     "doc_id", "text"))
    place = {r["number"]: r["first"]["row"]["key"] for r in distinct.collect()}
    got = {tuple(sorted((place[r["a"]], place[r["b"]]))) for r in lines.line_links(distinct).collect()}
    near = {(a, b) for a, x in enumerate(texts) for b in range(a + 1, len(texts)) if abs(len(x) - len(texts[b])) <= 40
            and len(set(x.split()) & set(texts[b].split())) * 2 >= len(x.split())
            and 10 * distance(x, texts[b]) <= max(len(x), len(texts[b]))}
    assert got <= near
    pairs = [(n, (a, b)) for n, a, b in made if (a, b) in near]
    assert len(pairs) > 180 and sum(p in got for _, p in pairs) >= 0.95 * len(pairs)
    assert all(p in got for n, p in pairs if n >= 20)


def groups_of(edges) -> dict:
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return {x: find(x) for x in root}


def linked_as(spark, texts, near):
    """The groups of line_links, and those of the pairs ``near``, as sets of texts."""
    distinct = lines.distinct_lines(lines.line_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"))
    text = {r["number"]: r["line"] for r in distinct.collect()}
    found = {frozenset((text[r["a"]], text[r["b"]])) for r in lines.line_links(distinct).collect()}
    assert found <= near

    def sets(pairs):
        of = {}
        for x, r in groups_of(sorted(map(sorted, pairs))).items():
            of.setdefault(r, set()).add(x)
        return {frozenset(g) for g in of.values()}

    return sets(found), sets(near)


def test_short_lines_lose_no_link(spark):
    """Chains of edited short lines: the connected groups are those of all pairs within the threshold."""
    rng = random.Random(5)
    texts = set()
    for _ in range(40):
        t = "".join(rng.choices("abcdef", k=rng.randint(10, 60)))
        for _ in range(5):
            texts.add(t)
            for _ in range(rng.randint(1, len(t) // 10)):
                x = rng.randrange(len(t))
                t = rng.choice([t[:x] + rng.choice("abcdef") + t[x + 1:], t[:x] + t[x + 1:], t[:x] + rng.choice("abcdef") + t[x:]])
            if not 10 <= len(t) <= lines.SHORT:
                break
    texts = sorted(texts)
    near = {frozenset((x, y)) for i, x in enumerate(texts) for y in texts[i + 1:]
            if 10 * abs(len(x) - len(y)) <= max(len(x), len(y)) and 10 * distance(x, y) <= max(len(x), len(y))}
    found, meant = linked_as(spark, texts, near)
    assert len(meant) > 20 and found == meant


def test_lines_of_different_heads_are_linked(spark):
    """Chains a, x, y, b in one bucket of many lines: x and y are linked also where a has taken x and b has taken y."""
    rng = random.Random(6)
    words = {"".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(4000)}
    block = spark.createDataFrame([(w,) for w in sorted(words)], "w string").select(
        "w", F.expr("pmod(pmod(xxhash64(w), 1000003), 6)").alias("b")).collect()
    same, other = [r["w"] for r in block if r["b"] >= 3], [r["w"] for r in block if r["b"] < 3]
    fixed, texts = rng.sample(same, 22), []
    for _ in range(60):
        w = rng.sample(other, 20)
        for step in range(4):
            w = [*w[:5 * step], *(rng.sample(other, 4) if step else w[5 * step:5 * step + 4]), *w[5 * step + 4:]]
            texts.append(" ".join([*fixed, *w]))
    near = {frozenset((texts[i], texts[j])) for i in range(len(texts)) for j in range(i // 4 * 4, i)
            if 10 * distance(texts[i], texts[j]) <= max(len(texts[i]), len(texts[j]))}
    found, meant = linked_as(spark, texts, near)
    assert len(near) >= 150 and found == meant


def test_edit_distances_at_the_limit(spark):
    """Pieces and stepped limits drop no pair whose edits are just allowed, wherever they are, and take none with one more."""
    rng = random.Random(21)
    rows = []
    for n in (10, 19, 40, 61, 200, 430):
        most = n // 10
        for spot in ("even", "start", "any"):
            for edits in sorted({0, 1, most // 4, most // 2, most, most + 1}):
                a = [rng.choice("abcdé ") for _ in range(n)]
                b, at = list(a), {"even": range(2, n, 8), "start": range(n)}.get(spot) or rng.sample(range(n), edits)
                for i in list(at)[:edits]:
                    b[i] = "z"
                rows.append(("".join(a), "".join(b)))
    rows = [(2 * i, 2 * i + 1, a, b) for i, (a, b) in enumerate(rows)]
    texts = spark.createDataFrame([(x, a) for x, _, a, _ in rows] + [(y, b) for _, y, _, b in rows], "number long, line string")
    pairs = spark.createDataFrame([(x, y) for x, y, _, _ in rows], "a long, b long")
    got = {r["a"] // 2 for r in lines.verified(pairs, texts, 0.9).collect()}
    assert got == {i for i, (_, _, a, b) in enumerate(rows) if 10 * distance(a, b) <= len(a)} and 0 < len(got) < len(rows)


def test_narrow_and_wide_vote_counters_agree(spark):
    """Lines of up to 255 words have counters of eight bits, which count like those of 32."""
    rng = random.Random(22)
    texts = [" ".join(f"w{rng.randrange(k)}" for _ in range(n)) for n in (1, 2, 7, 60, 254, 255, 256, 257, 700) for k in (1, 3, 900)]
    rows = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(texts)], "number long, line string, size int")
    words = rows.select("number", "size", F.split("line", " ").alias("words"))
    wide = {tuple(r) for r in lines.voted(words, 32).collect()}
    assert {tuple(r) for r in lines.simhashes(rows).collect()} == wide and len(wide) == len(texts)
    for r in lines.simhashes(rows).collect():
        assert sum(r[f"t{k}"] for k in range(lines.BLOCKS)) == len(texts[r["number"]].split(" "))


def test_votes_do_not_overflow(spark):
    """A word that comes 127 to 300 times in a line votes so often on the highest bits, where the long's sign is."""
    words = ["".join(random.Random(k).choices(string.ascii_lowercase, k=6)) for k in range(64)]
    texts = [" ".join([w] * n) for w in words for n in (127, 128, 200, 255, 256, 300)]
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "number long, line string, size int")
    got = {r["number"]: r["simhash"] for r in lines.simhashes(rows).collect()}
    assert len(got) == len(texts) and min(got.values()) < 0
    assert all(len({got[i + k] for k in range(6)}) == 1 for i in range(0, len(texts), 6))


def test_buckets_are_shuffled_in_parts(spark, monkeypatch):
    """A part of the buckets is counted, and its shuffle dropped, before the part is joined; together they find the same links."""
    rng = random.Random(23)
    base = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta"], k=14)) for _ in range(30)]
    texts = base + [x + "s" for x in base]
    distinct = lines.distinct_lines(lines.line_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"))
    written, write = [], lines.materialize

    def noted(df, name="stage"):
        out = write(df, name)
        written.append((name, out))
        return out

    monkeypatch.setattr(lines, "materialize", noted)
    linked = {}
    for parts in (1, lines.PARTS):
        monkeypatch.setattr(lines, "PARTS", parts)
        written.clear()
        linked[parts] = {frozenset(r) for r in lines.line_links(distinct).collect()}
        names = [n for n, _ in written]
        assert names.count("line-shared") == names.count("line-buckets") == parts
        sizes = [d.count() for n, d in written if n == "line-buckets"]
    assert len(linked) == 2 and len(set(map(frozenset, linked.values()))) == 1 and len(linked[1]) >= 30
    assert len(sizes) >= 2 and max(sizes) < 0.75 * sum(sizes)


def test_common_ends_are_exact(spark):
    rng = random.Random(2)
    made = ["".join(rng.choices("ab é", k=rng.randint(0, 9))) for _ in range(60)]
    rows = [(i, a) for i, a in enumerate(dict.fromkeys(made))]
    texts = spark.createDataFrame(rows, "number long, line string")
    pairs = texts.select(F.col("number").alias("a")).join(texts.select(F.col("number").alias("b")), F.col("a") < F.col("b"))
    got = {(r["a"], r["b"]) for r in lines.verified(pairs, texts, 0.6).collect()}
    assert got == {(i, j) for i, a in rows for j, b in rows if i < j and distance(a, b) <= int(0.4 * max(len(a), len(b)) + 1e-9)}
    long_line = " ".join(f"w{i}" for i in range(20_000))
    two = spark.createDataFrame([(1, f"{long_line} end"), (2, f"{long_line} fin")], "number long, line string")
    one = spark.createDataFrame([(1, 2)], "a long, b long")
    assert lines.verified(one, two, 0.9).count() == 1


def test_poisson_counts(spark):
    u = [i / 997 for i in range(997)]
    df = spark.createDataFrame([(r, x) for r in (0.0, 0.3, 2.5, 29.0, 95.0) for x in u], "rate double, u double")
    got = df.select("rate", "u", mixing.poisson_count(F.col("rate"), F.col("u")).alias("k")).collect()
    mean = defaultdict(list)
    for r in got:
        mean[r["rate"]].append(r["k"])
        if r["rate"] <= 30:
            cdf = lambda k: sum(math.exp(-r["rate"]) * r["rate"] ** i / math.factorial(i) for i in range(k + 1))  # noqa: B023, E731
            assert cdf(r["k"]) > r["u"] - 1e-12 and (r["k"] == 0 or cdf(r["k"] - 1) <= r["u"] + 1e-12)
    for rate, ks in mean.items():
        assert abs(np.mean(ks) - rate) <= 0.05 + 0.06 * rate


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, "x" * 99, "big" if i % 10 else "small") for i in range(6000)], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, {"big": 1.0, "small": 1.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 3000) < 300 and abs(n["small"] - 3000) < 300
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix_sources(docs, {"small": 2.0, "big": 2.0}).collect()))
    assert {r["source"] for r in mixing.mix_sources(docs, {"small": 1.0}).select("source").distinct().collect()} == {"small"}
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == [*odd.columns, "_copy"] and mixing.mixed(spark, odd, "").columns == odd.columns
    assert mixing.mix_sources(none).count() == 0


def test_matrix_sums_and_law():
    matrix = np.array(sharding.communication_matrix([7, 0, 13, 40, 1], sharding.shard_sizes(61, 4), 1))
    assert matrix.sum(1).tolist() == [7, 0, 13, 40, 1] and matrix.sum(0).tolist() == [16, 15, 15, 15]
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 600_000_000, 900_000_000, 1000) for _ in range(400)]
    assert abs(np.mean(draws) - 400) < 4 and 13 < np.std(draws) < 18


def test_sharding(spark, odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 40)
    df = spark.range(1003).withColumnRenamed("id", "doc_id")
    rows = sharding.shard(df, 16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == list(range(1003)) and {len(v) for v in by.values()} == {62, 63}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shard(df.repartition(7), 16).collect()))
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, range(1003))[0, 1]) < 0.12
    out = sharding.shard(odd, 5)
    assert out.columns == [*odd.columns, "_shard", "slot"] and out.count() == 12 and sharding.shard(none, 4).count() == 0


def test_copies_spread_over_the_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 40)
    blocks, drawn = [], sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda sizes, *rest: blocks.extend(sizes) or drawn(sizes, *rest))
    few = spark.range(300).selectExpr("id AS doc_id", "explode(sequence(1, 4)) AS k").select("doc_id")
    df = few.unionByName(spark.range(600).selectExpr("-1L AS doc_id")).unionByName(spark.range(3).selectExpr("CAST(NULL AS long) AS doc_id"))
    rows = sharding.shard(df, 16).collect()
    where, slots = defaultdict(list), defaultdict(list)
    for r in rows:
        where[r["doc_id"]].append(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert {k: len(v) for k, v in where.items()} == {**dict.fromkeys(range(300), 4), -1: 600, None: 3}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} == {112, 113}
    assert sum(len(set(where[i])) == 1 for i in range(300)) < 10 and sum(len(set(where[i])) for i in range(300)) > 1000
    assert len(set(where[-1])) == 16 and max(Counter(where[-1]).values()) < 80
    assert max(blocks) < 80                  # the 600 equal rows are not one block
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard(df.repartition(5), 16).collect()))


def brute_lm(rows, train, order):
    """Per id: tokens, known tokens, base score and score, by dictionaries of word tuples."""
    end = "\n"
    split = {i: re.findall(r"[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [end] for i, t in rows}

    def grams(words):
        padded = [end] * (order - 1) + words
        return [tuple(padded[k: k + order]) for k in range(len(words))]

    times = Counter(w for i in train for w in split[i])
    value = {order: Counter(g for i in train for g in grams(split[i]))}
    for n in range(order - 1, 0, -1):
        value[n] = Counter(g[1:] for g in value[n + 1])
    cut, followers = {}, {}
    for n, table in value.items():
        of = Counter(table.values())
        cut[n] = (0, *lm.discounts(*[of[i] for i in (1, 2, 3, 4)]))
        followers[n] = {}
        for g, f in table.items():
            followers[n].setdefault(g[:-1], []).append(f)

    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else 1 / (len(times) + 1)
        seen = followers[n].get(g[:-1])
        if not seen:
            return low
        f = value[n][g]
        rest = sum(cut[n][min(c, 3)] for c in seen)
        return (max(f - cut[n][min(f, 3)], 0) + rest * low) / sum(seen)

    total = sum(times.values())
    return {i: (len(words), sum(w in times for w in words),
                sum(math.log10((times[w] + 0.1) / (total + 0.1 * (len(times) + 1))) for w in words),
                sum(math.log10(p(g)) for g in grams(words))) for i, words in split.items()}


@pytest.mark.parametrize("order", [3, 2, 4])
def test_language_model_equals_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "SHARD_BYTES", 3000)
    monkeypatch.setattr(lm, "BATCH_BYTES", 1500)
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)] + ["The", "é", "of."]
    rows = [(i, " \n".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "x " * 900)]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(df.where((F.crc32(F.col("doc_id").cast("string")) % 10) != 0), order=order)
    want = brute_lm(rows, train, order)
    scored = lm.score(df, model)
    model.discard()
    got = scored.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2]
        assert (r["base_score"], r["score"]) == pytest.approx(want[r["doc_id"]][2:], rel=1e-9)


def test_language_model_packing():
    values = np.array([[0, 1, 255, 256, 1 << 40], [0, 0, 0, 0, 0]])
    assert (lm.lift(lm.lay(values), 2, 5) == values).all() and lm.lift(lm.lay([values[0][:0]]), 1, 0).shape == (1, 0)
    keys = np.array([0, 3, 1 << 30, (1 << 56) - 1], np.uint64)
    assert (lm.unpack(lm.pack(keys)) == keys).all() and [s for s, _ in lm.by_shard(keys, lm.bounds(4))] == [0, 3]


def test_rounds_of_scoring_share_the_hashes(spark):
    """A batch sorts each hash in one round only; together the rounds ask for all."""
    import pyarrow as pa

    grams = lm.Grams(pa.array([" ".join(f"w{i * i % 97}" for i in range(500)), None, "a b"], pa.large_string()).fill_null(""), 3)
    cuts = [0, 1 << 53, 1 << 55, 1 << 56]
    for n in (1, 2, 3):
        parts = [grams.asked(n, a, b) for a, b in zip(cuts, cuts[1:])]
        assert (np.concatenate(parts) == grams.asked(n)).all() and all(len(p) < len(grams.asked(n)) for p in parts)


def test_batches_hold_tokens():
    """Words are cut and hashed once, when a batch is written; later steps read the same tokens."""
    import pyarrow as pa

    texts = pa.array(["", "b a b", " \n", "É c " * 70_000, "the end"], pa.large_string())
    keys = pa.array(range(5), pa.int64())
    held = list(lm.gather([pa.record_batch([keys, texts], names=["key", "text"])], 100))
    assert sum(len(b["keys"][0]) for b in held) == 5 and len(held) > 1
    whole = lm.Grams(texts, 3)
    parts = [lm.opened(b, 0, 3) for b in held]
    assert np.concatenate([g.count for g in parts]).tolist() == whole.count.tolist()
    for n in (1, 2, 3):
        assert (np.concatenate([g.keys[n][: g.n] for g in parts]) == whole.keys[n][: whole.n]).all()


def test_language_model_odd_rows(odd, none):
    model = lm.train(odd)
    assert lm.score(odd, model).count() == 12 and lm.score(none, model).count() == 0
    untrained = lm.score(odd, lm.train(none)).collect()
    assert len(untrained) == 12 and all(r["score"] == 0 and r["n_known"] == 0 for r in untrained)


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "sharding"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.select("shard", "slot").collect()
    assert len(rows) > 50 and len({tuple(r) for r in rows}) == len(rows)
