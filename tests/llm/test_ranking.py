"""Bags, centroids and languages against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultsieve.llm import bag_ranking as B
from faultsieve.llm import sphere_means as S
from faultsieve.llm import word_language as L

ITEM = "item_id long, text string, score int, doc_id int"


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(B.UPPER, B.LOWER)))


def _ranked(docs, items, most):
    bags = [(d, _terms(t)) for d, t in docs]
    n_docs, total = sum(1 for _, t in bags if t), sum(len(t) for _, t in bags)
    df = Counter(w for _, t in bags for w in set(t))
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(_terms(t))
    out = set()
    for i, words in wanted.items():
        found = []
        for d, t in bags:
            tf, m = Counter(t), 50 + (50 * len(t) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in words if tf[w])
            if score > 0 and d is not None:
                found.append((-score, d))
        out |= {(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:most], 1)}
    return out


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "delta9", "épée", "ÉPÉE", "x", "y", "zz", "Straße", "日本", "o'clock", "a-b"]
    rows = [(k, " ".join(rng.choice(words) + rng.choice(["", ",", "!", "\n"]) for _ in range(rng.randrange(1, 12)))) for k in range(n)]
    rows += [(n + k, "alpha x alpha, zz") for k in range(40)] + [(500 + k, "x  ALPHA zz unknown") for k in range(9)] + [(501, "x alpha zz unknown")]
    return rows + [(900, None), (901, ""), (902, "?!"), (None, "alpha beta"), (903, "alpha " * 3000 + "beta")]


@pytest.mark.parametrize("most,size,mask", [(5, B.BROADCAST_BYTES, -1), (50, 0, -1), (3, B.BROADCAST_BYTES, 1)])
def test_ranks_as_brute_force(spark, documents, most, size, mask):
    """Also with a vocabulary that is not broadcast, and with a hash that nearly all bags share."""
    rows = _texts(most, 60)
    items = [(1, "alpha zz beta"), (2, "ÉPÉE straße"), (3, None), (4, "!!"), (5, "nowhere"), (None, "x"), (6, "X x, x y"), (7, "日本 x"), (7, "GAMMA")]
    found = B.rank(documents(rows), spark.createDataFrame([(*i, 0, 0) for i in items], ITEM), most, size, mask).collect()
    assert {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found} == _ranked(rows, items, most)
    assert len(found) == len(_ranked(rows, items, most))


def test_items_in_blocks_and_classes_scored_once(spark, documents, monkeypatch):
    rows, items = _texts(8, 50), [(k, f"alpha x {'beta' if k % 2 else 'zz'}") for k in range(9)]
    monkeypatch.setattr(B, "ITEMS", 2)
    table = spark.createDataFrame([(*i, 0, 0) for i in items], ITEM)
    found = B.rank(documents(rows), table, 12).collect()
    assert {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found} == _ranked(rows, items, 12)
    copies = {r["class_id"] for r in found if r["doc_id"] in range(50, 90)}
    assert len(copies) == 1


def test_empty_ranking(spark, documents):
    items = spark.createDataFrame([(1, "a", 0, 0)], ITEM)
    assert B.rank(documents([]), items).count() == 0
    assert B.rank(documents([(1, "a")]), items.where("false")).count() == 0
    assert [tuple(r)[:3] for r in B.rank(documents([(1, "a"), (2, "b")]), items).collect()] == [(1, 1, 1)]


# centroids


def _means(rows, count, rounds):
    kept = [(k, [math.floor(256 * c) for c in v]) for k, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) and abs(c) < S.LARGEST / 256 for c in v)]
    named = sorted((hashlib.sha256(f"2:{k}".encode()).hexdigest(), x) for k, x in kept if k is not None)[:count]
    centroids = [x for _, x in named]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for k in range(len(centroids)):
            mine = [x for (_, x), o in zip(kept, own) if o == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((k, near(x)[1], near(x)[0], hashlib.sha256(",".join(map(str, centroids[near(x)[1]])).encode()).hexdigest()) for k, x in kept), key=repr)


def _vectors(seed, n, blobs=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (blobs, 64))
    rows = [(k, (centres[k % blobs] + rng.normal(0, 0.05, 64)).tolist()) for k in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(30)] + [(5, rows[5][1]), (None, rows[7][1])]  # copies, an id twice, no id
    odd = [None, [], [0.1] * 63, [0.1] * 63 + [None], [0.1] * 63 + [math.nan], [0.1] * 63 + [math.inf], [0.0] * 63 + [1e300]]
    return rows + [(10_000 + k, v) for k, v in enumerate(odd)] + [(11_000, [0.0] * 64), (11_001, [-3000.5] * 64), (11_002, [-3000.5] * 63 + [300_000.0])]


@pytest.mark.parametrize("seed,n,count", [(1, 300, 8), (2, 120, 40)])
def test_clusters_as_brute_force(spark, seed, n, count):
    rows = _vectors(seed, n)
    table = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<double>, cluster int, distance int")
    found = S.cluster(table, count=count).collect()
    expected = _means(rows, count, S.ROUNDS)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in found), key=repr) == expected
    assert {r["inertia"] for r in found} == {sum(e[2] for e in expected)}
    sums = Counter()
    for e in expected:
        sums[e[1]] += e[2]
    assert all(r["cluster_inertia"] == sums[r["cluster"]] for r in found)
    assert sum(r["scanned"] for r in found) < len(found) / 2 or count > 20, "bounds must spare most scans of separate clusters"


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert S.cluster(spark.createDataFrame([], kind)).count() == 0
    rows = S.cluster(spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], kind)).collect()
    assert {r["distance"] for r in rows} == {0} and {r["cluster"] for r in rows} == {0, 1}


def test_loosening_holds_and_is_less_than_the_drift():
    rng = np.random.default_rng(3)
    less = 0
    for trial in range(300):
        before = rng.normal(0, 100, (6, 8)).round().astype(np.int64)
        after = before + rng.normal(0, rng.choice([1, 30, 200]), (6, 8)).round().astype(np.int64)
        after[trial % 6] = before[trial % 6]
        radius = rng.uniform(0, 150, 6)
        amount = S.loosening(before, after, radius)
        drift = np.sqrt(((after - before) ** 2).sum(1))
        for i in range(6):
            others = [j for j in range(6) if j != i]
            x = rng.normal(size=(200, 8))
            x = before[i] + x / np.sqrt((x**2).sum(1))[:, None] * radius[i] * rng.uniform(0, 1, 200)[:, None] ** 0.1
            nearer = max((np.sqrt(((x - before[j]) ** 2).sum(1)) - np.sqrt(((x - after[j]) ** 2).sum(1))).max() for j in others)
            assert nearer <= amount[i] + 1e-6
            assert amount[i] <= drift[others].max() + 1e-6
            less += amount[i] < 0.9 * drift[others].max()
    assert less > 300
    same = np.array([[0, 0], [0, 0], [9, 9]])
    amounts = S.loosening(same, same + np.array([[3, 0], [0, 0], [0, 1]]), np.array([1.0, 0.0, 2.0]))
    assert np.isfinite(amounts).all() and -0.73 < amounts[1] < -0.72, "both others move away"


# languages


def _say(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)) + ". "


def _corpus(seed, n):
    rng = random.Random(seed)
    made = {"aa": ["".join(rng.choice(["ka", "lo", "mi"]) for _ in range(rng.randrange(1, 5))) for _ in range(80)], "bb": ["".join(rng.choice(["sch", "ung", "ei", "ka"]) for _ in range(rng.randrange(1, 5))) for _ in range(80)], "cé": ["".join(rng.choice(["ñá", "ción", "lo"]) for _ in range(rng.randrange(1, 5))) for _ in range(80)]}
    return made, [(k, _say(rng, made[lang], rng.randrange(8, 30)), lang) for k, lang in ((k, rng.choice(list(made))) for k in range(n))]


def _as_table(spark, rows):
    return spark.createDataFrame([(k, t, lang, 0.5, "x") for k, t, lang in rows], "doc_id long, text string, lang string, score double, word string")


def test_language_of_held_out_documents(spark):
    made, rows = _corpus(1, 240)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 + 3 = %", "bb"), (1003, "ungei schei", None), (None, "kalo mi", "aa"), (1005, "x" * 200_000, "aa"), (0, rows[0][1], rows[0][2])]
    found = L.identify(_as_table(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in found}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k in by if k is not None and by[k]["held_out"]} == {k for k in by if k is not None and zlib.crc32(str(k).encode()) % 3 == 1}
    assert all(by[k]["lang_pred"] == rows[k][2] for k in held) and len(held) > 40
    assert all(0 <= r["score"] <= 1 for r in found)
    assert [(by[k]["lang_pred"], by[k]["score"]) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003]["lang_pred"] == "bb" and by[None]["lang_pred"] == "aa" and not by[None]["held_out"]


def test_held_out_rows_and_ids_do_not_matter(spark):
    _, rows = _corpus(2, 90)
    swapped = [(k, t if zlib.crc32(str(k).encode()) % 3 != 1 else "zzz", lang if zlib.crc32(str(k).encode()) % 3 != 1 else "aa") for k, t, lang in rows]
    one, two = L.train(_as_table(spark, rows)), L.train(_as_table(spark, swapped))
    assert one.words == two.words and np.array_equal(one.word_logs, two.word_logs) and one.grams == two.grams


def test_model_counts_as_brute_force(spark):
    """Word and n-gram frequencies, the longest known n-grams of an unseen word, and the sums."""
    _, rows = _corpus(3, 60)
    model = L.train(_as_table(spark, rows))
    learned = [(t, lang) for k, t, lang in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    counts = Counter((w, lang) for t, lang in learned for w in re.findall(r"\w+", t.lower()))
    words = {w for w, _ in counts if sum(counts[w, lang] for lang in model.languages) >= L.LEAST}
    assert set(model.words) == words and model.languages == sorted({lang for _, lang in learned})
    total = {lang: sum(n for (_, g), n in counts.items() if g == lang) for lang in model.languages}
    log = lambda w, lang: math.log((counts[w, lang] + L.SMOOTH) / (total[lang] + L.SMOOTH * (len(words) + 1)))
    assert all(np.allclose(model.word_logs[model.words[w]], [log(w, lang) for lang in model.languages]) for w in words)
    parts = Counter()
    for (w, lang), n in counts.items():
        for i in range(len(w) - 0):
            parts[f"<{w}>"[i : i + 3], lang] += n
    unseen = "milomika" * 3
    known = [g for g in (f"<{unseen}>"[i : i + 5] for i in range(len(unseen) - 2)) if g in model.grams[5]]
    assert unseen not in words and known
    assert np.allclose(model.backed_off(unseen), np.mean([model.gram_logs[5][model.grams[5][g]] for g in known], axis=0))
    short = next(g for g, _ in parts if len(g) == 3 and parts[g, "aa"] > 5)
    sizes = {lang: sum(n for (_, g), n in parts.items() if g == lang) for lang in model.languages}
    value = [math.log((parts[short, lang] + L.SMOOTH) / (sizes[lang] + L.SMOOTH * (len(model.grams[3]) + 1))) for lang in model.languages]
    assert np.allclose(model.gram_logs[3][model.grams[3][short]], value)
    text = f"{next(iter(words))} {unseen} {unseen}"
    assert np.allclose(model.sums(text, {}), model.word_logs[model.words[next(iter(words))]] + 2 * model.backed_off(unseen))
    assert np.allclose(model.backed_off("qqq"), 0)


def test_training_rows_are_those_of_least_hash(spark):
    _, rows = _corpus(4, 150)
    table = _as_table(spark, [(k, f"w{k}", "aa" if k % 10 else lang) for k, _, lang in rows])
    usable = table.where("crc32(cast(doc_id as string)) % 3 <> 1")
    want = usable.selectExpr("*", "row_number() over (partition by lang order by xxhash64(doc_id)) n").where("n <= 7").select("text", "lang")
    assert sorted(map(tuple, L.training_rows(table, 7).collect())) == sorted(map(tuple, want.collect()))


def test_nothing_to_learn(spark):
    table = _as_table(spark, [(1, "kalo", None), (2, "mi", None)])
    assert {(r["lang_pred"], r["score"]) for r in L.identify(table).collect()} == {("und", 0.0)}
    assert L.identify(table.where("false")).count() == 0
