"""Secret scans with a random forest that removes false positives, in DataFrame functions and Spark ML only.

Candidates are of two kinds. A run of 16 or more characters of base64 or its URL form within a word is one anywhere; '=' belongs to it
as padding at the end only, so a name that a value is assigned to without space or quotes is text in front of it. A value
of 6 or more characters of any kind but quotes and separators is one where it is assigned to a name of a credential.
Features are the length, how likely the character transitions are, how much of the candidate dictionary words cover, what the path
(a column, by default source) names, and the words around: credential names, names of harmless digests, assignments and
quotes. Transitions and the dictionary come from counts over all words of all documents; a word of four to twelve letters that occurs
`LEAST_COUNT` times or more is in the dictionary, which is a table and is joined.

The forest learns from labelled findings: candidates with a 0 or 1. The tables hold none, so `plant` makes them: it puts secrets and
look-alikes into texts of a bounded sample of documents (`PLANTED`, those with the least hashes). Look-alikes are digests, ids, identifiers
and paths of the document's own words, placeholders assigned to credential names, and secrets within test files; secrets are keys and
passwords in many forms, with a name, behind a name of two words, or by themselves. What was planted is the label; no
rule over the features makes it. `scan` takes other findings with labels instead.

Defined cases: null and empty texts have no candidates; with no finding of one of the labels each probability is the share
of label 1 (0.5 without findings); repeated rows give repeated findings; a null path is empty; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

TRAIN_FINDINGS = 20_000
#: How many values are planted in all, and in one document.
PLANTED, MOST_PLANTED = 10_000, 200
#: A word of the dictionary occurs so often, and has so many letters.
LEAST_COUNT = 5
SHORTEST, LONGEST = 4, 12
#: A whole run with its padding; not a run that a sign and a value follow, which is a name.
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-])|(?!=+[A-Za-z0-9+/_-]))"
CREDENTIAL = "(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)"
SIGN = r"[\"'`)]?\s*(?::=|=>|[=:])\s*[\"'`(]*"
#: A value behind an assignment to a credential name in the same word; and the words before a value that are such an assignment.
INSIDE = CREDENTIAL[:4] + "(?:" + CREDENTIAL[5:-1] + r")[\w.-]{0,20}" + SIGN + "([^\"'`,;&?{}<>()\\s]{6,})"
AHEAD = CREDENTIAL + r"[\w.-]{0,20}" + SIGN + "$"
HARMLESS = "(?i)(commit|sha\\d*|md5|checksum|digest|hash|uuid|guid|revision|etag|example|dummy)"
TEST_PATH = r"(?i)(^|[/._-])(tests?|mocks?|fixtures?|examples?|samples?|docs?)([/._-]|$)"
#: Characters that transitions tell apart: letters in lower case, any digit as 0; all others are one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0"
FEATURES = ["length", "transition", "coverage", "digits", "uppers", "kinds", "variety", "marks", "credential", "harmless", "assigned", "quoted", "test_path", "slashes", "before_length", "after_length"]
NAMES = ["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "passwd", "db_password", "private_key"]


def words(docs: DataFrame) -> DataFrame:
    """Counts of all runs of letters and digits of all texts, in lower case: word, n."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))
    return docs.select(found.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def transitions(counts: DataFrame) -> list[float]:
    """Log probabilities of transitions, a square by ALPHABET and others."""
    pairs = counts.select("n", F.explode(F.regexp_extract_all(F.regexp_replace("word", "[0-9]", "0"), F.lit("(?=(..))"), F.lit(1))).alias("pair"))
    locate = lambda i: F.expr(f"locate(substring(pair, {i}, 1), '{ALPHABET}')")
    width = len(ALPHABET) + 1
    seen = [[0.5] * width for _ in range(width)]
    for r in pairs.groupBy(locate(1).alias("a"), locate(2).alias("b")).agg(F.sum("n").alias("n")).collect():  # at most 28 * 28 rows
        seen[r["a"]][r["b"]] += r["n"]
    return [math.log(x / sum(row)) for row in seen for x in row]


def _beside(name: str, at: Column) -> Column:
    return F.coalesce(F.get(name, at), F.lit(""))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """One row for each candidate: doc_id, word (its number in the text), nth (in the word), candidate, and what stands around it."""
    split = F.split("text", r"[\x20\x09-\x0D]+")
    behind_sign = lambda i: F.coalesce(F.get("ws", i - 1).rlike(r"[=:][\"'`(]?$"), F.lit(False))
    open_ = lambda x, i: ((F.length(x) >= 16) & x.rlike(CANDIDATE)) | ((F.length(x) >= 6) & (x.rlike(INSIDE) | behind_sign(i)))
    kept = F.filter(F.transform("ws", lambda x, i: F.when(open_(x, i), F.struct(i.alias("i"), x.alias("w")))), lambda x: x.isNotNull())
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), split.alias("ws")).withColumn("c", F.explode(kept))
    i = F.col("c.i")
    rows = rows.select("doc_id", "path", i.alias("word"), F.col("c.w").alias("w"), *[_beside("ws", i - k).alias(f"b{k}") for k in (1, 2, 3)], _beside("ws", i + 1).alias("a1"))
    inside = F.regexp_extract_all("w", F.lit(INSIDE), F.lit(1))
    ahead = F.when(F.concat_ws(" ", "b3", "b2", "b1").rlike(AHEAD), F.regexp_extract("w", "^[\"'`(]*([^\"'`,;<>{}()]{6,})", 1))
    named = F.array_distinct(F.filter(F.concat(inside, F.array(ahead)), lambda x: x != ""))
    long = F.regexp_extract_all("w", F.lit(CANDIDATE), F.lit(0))
    rows = rows.withColumns({"named": named, "long": long})
    all_ = F.concat("named", F.filter("long", lambda x: ~F.exists("named", lambda y: y.contains(x))))
    return rows.select("doc_id", "path", "word", "w", "b1", "b2", "b3", "a1", F.posexplode(all_).alias("nth", "candidate"))


def coverage(strings: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, covered): how many letters of each candidate (id, candidate) words of the dictionary cover."""
    letters = r"\p{L}{%d,%d}"
    known = counts.where((F.col("n") >= LEAST_COUNT) & F.col("word").rlike("^" + letters % (SHORTEST, LONGEST) + "$")).select(F.col("word").alias("piece"))
    # a match for each character: the letters that begin there, or nothing
    begun = F.regexp_extract_all(F.lower("candidate"), F.lit(f"(?s)(?=({letters % (SHORTEST, LONGEST)}))|."), F.lit(1))
    starts = strings.select("id", F.posexplode(begun).alias("at", "ahead")).where("ahead <> ''")
    pieces = starts.withColumn("n", F.explode(F.sequence(F.lit(SHORTEST), F.length("ahead")))).select("id", "at", "n", F.expr("left(ahead, n)").alias("piece"))
    found = pieces.join(known, "piece").groupBy("id", "at").agg(F.max("n").alias("n"))
    before = F.max(F.col("at") + F.col("n")).over(W.partitionBy("id").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("id").agg(F.sum(F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest("at", "before"))).alias("covered"))


def featurize(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds FEATURES to candidates; counts are those of `words`."""
    c, table = F.col("candidate"), transitions(counts)
    n = F.length(c).cast("double")
    width = len(ALPHABET) + 1
    codes = F.expr(f"transform(split(regexp_replace(lower(candidate), '[0-9]', '0'), ''), x -> if(x = '', 0, locate(x, '{ALPHABET}')))")
    found = found.withColumn("_id", F.md5("candidate"))
    covered = coverage(found.groupBy(F.col("_id").alias("id")).agg(F.first("candidate").alias("candidate")), counts)
    rows = found.join(covered, found["_id"] == covered.id, "left").withColumn("_codes", codes).withColumn("_k", F.size("_codes"))
    logs = F.array(*[F.lit(x) for x in table])
    steps = F.zip_with(F.slice("_codes", 1, F.col("_k") - 1), F.slice("_codes", 2, F.col("_k") - 1), lambda a, b: F.element_at(logs, a * width + b + 1))
    before = F.split_part(F.col("w"), c, F.lit(1))
    cut = lambda x: F.regexp_extract(x, "[^,;&?{}]*$", 0)  # noqa: E731  the last parameter or member only
    in_word = before.rlike(r"\w[\"']?[=:][\"'`]?$")  # the name stands in the word itself, so other words' names are not its own
    around = F.when(in_word & (cut(before) != before), cut(before)).otherwise(cut(F.concat_ws(" ", "b3", "b2", "b1", before)))
    rows = rows.withColumn("_around", around)
    sign = r"[\"'`)]?\s*(?::=|=>|[=:])?\s*[\"'`(]*$"
    name = F.regexp_extract("_around", r"([\w-]+)" + sign, 1)
    names = F.regexp_extract("_around", r"(?:[\w-]+\s)?[\w-]+" + sign, 0)
    flag = lambda x: x.cast("double")
    count = lambda p: F.regexp_count(c, F.lit(p)).cast("double")
    return rows.withColumns({
        "length": n,
        "transition": F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.col("_k") - 1, F.lit(1)),
        "coverage": F.coalesce("covered", F.lit(0)) / n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "kinds": flag(c.rlike("[a-z]")) + flag(c.rlike("[A-Z]")) + flag(c.rlike("[0-9]")) + flag(c.rlike("[^A-Za-z0-9]")),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
        "marks": count("[^A-Za-z0-9]") / n,
        "credential": flag(F.when(F.col("_around").rlike(r"[=:]\s*[\"'`(]*$"), names).otherwise(name).rlike(CREDENTIAL)),
        "harmless": flag(name.rlike(HARMLESS)),
        "assigned": flag(F.col("_around").rlike(r"[=:]\s*[\"'`(]*$")),
        "quoted": flag(F.col("w").rlike("[\"'`]")),
        "test_path": flag(F.col("path").rlike(TEST_PATH)),
        "slashes": F.regexp_count("path", F.lit("/")).cast("double"),
        "before_length": F.length("b1").cast("double"),
        "after_length": F.length("a1").cast("double"),
    }).drop("_codes", "_k", "_around", "_id", "id", "covered")


def plant(docs: DataFrame, salt: int = 0, limit: int | None = None, path: str = "source") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text, source) with one planted value each, and the values (doc_id, candidate, label).

    They are made of those documents that have the least hashes, at most limit; of fewer, each is used several times. Their
    ids are numbers of their own.
    """
    limit = limit or PLANTED
    draw = lambda k, m: F.pmod(F.xxhash64("u", F.lit(k)), F.lit(m)).cast("int")
    base = F.sha2(F.concat_ws("|", F.lit(salt), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))), 256)
    n = docs.count()
    # of many documents about twice the limit are looked at, by hash, so that few texts are sorted
    few = docs.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, 2 * limit / max(1, n)) * (1 << 30)))
    some = few.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("source"), base.alias("base")).orderBy("base").limit(limit)
    times = min(MOST_PLANTED, max(1, limit // max(1, n)))
    some = some.withColumn("u", F.explode(F.transform(F.sequence(F.lit(1), F.lit(times)), lambda i: F.sha2(F.concat_ws("|", "base", i.cast("string")), 512)))).drop("base")
    some = some.withColumns({"ws": F.split("text", r"[\x20\x09-\x0D]+"), "doc_id": F.xxhash64("u")})
    mixed = F.base64(F.unhex(F.col("u")))
    plain = F.regexp_replace(F.regexp_replace(mixed, "[^A-Za-z0-9]", ""), r"\s", "")
    own = lambda k: F.lower(F.regexp_replace(F.element_at("ws", draw(k, 1 << 20) % F.size("ws") + 1), r"[^\p{L}]", ""))
    hexes = lambda k: F.substring("u", F.lit(1), F.element_at(F.array(*[F.lit(x) for x in (32, 40, 64)]), draw(k, 3) + 1))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    of = lambda k, values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), draw(k, len(values)) + 1)
    sub = lambda c, a, n: F.substring(c, F.lit(a), F.lit(n) if isinstance(n, int) else n)

    keys = of(1, [
        hexes(2), sub(plain, 1, 20 + draw(3, 24)), F.translate(sub(mixed, 1, 40), "+/\n", "-_x"), text(sub(plain, 5, 42), "=="),
        text(of(4, ["sk_live_", "ghp_", "xoxb-"]), sub(plain, 1, 24)), text("AKIA", F.upper(sub(plain, 1, 16))), sub(F.col("u"), 9, 40), sub(F.col("u"), 3, 40),
    ])
    passwords = of(5, [
        text(F.initcap(own(6)), draw(7, 100).cast("string"), of(8, ["!", "#", "$", "@"]), sub(plain, 3, 4)), text(sub(plain, 1, 5), of(9, ["$", "!", "%", "*"]), sub(plain, 9, 5), "@", draw(10, 10).cast("string")),
        sub(plain, 30, 12), text(own(11), draw(12, 1000).cast("string"), sub(plain, 20, 3), "!"),
    ])
    digests = of(13, [hexes(14), F.concat_ws("-", sub("u", 1, 8), sub("u", 9, 4), sub("u", 13, 4), sub("u", 17, 4), sub("u", 21, 12)), F.regexp_replace(sub("u", 1, 20), "[a-f]", "7")])
    parts = [own(k) for k in (15, 16, 17, 18)]
    identifiers = of(19, [F.concat_ws("_", *parts), F.concat_ws("/", F.lit("src"), *parts), F.concat_ws("-", *parts), text(parts[0], *[F.initcap(p) for p in parts[1:]]), F.concat_ws("_", *parts[:3], draw(20, 100).cast("string"))])
    blanks = of(21, [
        text("your-", own(22), "-here"), "changeme", text("changeme", draw(23, 1000).cast("string")), text("example-", own(24), "-", draw(25, 100).cast("string")), F.repeat(F.lit("x"), 8 + draw(26, 24)),
        text("<", own(27), "-", own(28), ">"), text("${", F.upper(own(29)), "_", F.upper(own(30)), "}"), F.concat_ws("_", own(31), own(32), own(33)), text(own(34), own(35)), "123456789", "required", "undefined",
    ])
    name = of(36, NAMES)
    assigned = lambda v: of(37, [
        text(name, ' = "', v, '"'), text(F.upper(name), "=", v), text('"', name, '": "', v, '"'), text(name, ": ", v), text("--", name, "=", v), text("https://host.net/p?page=2&", name, "=", v, "&x=1"),
        text(name, " = '", v, "'"), text("export ", F.upper(name), '="', v, '"'), text("the api key = ", v), text('{"id":"', sub("u", 60, 20), '","', name, '":"', v, '"}'), text(own(38), "@mail.example.com ", name, ' = "', v, '"'), text(name, ' = "', v, '"'),
    ])
    harmless = lambda v: of(39, [text("commit ", v), text("sha256: ", v), text('checksum = "', v, '"'), text("etag:", v), text("revision ", v), v, text("/objects/", v), text("uuid = ", v), text("commit=", v), text(own(40), ' = "', v, '"'), text('{"sha":"', v, '","token_count":"12"}')])
    kinds = [
        (1, keys, assigned(keys)), (1, keys, assigned(keys)), (1, keys, assigned(keys)), (1, passwords, assigned(passwords)), (1, keys, text("Authorization: Bearer ", keys)), (1, text("sk_live_", sub(plain, 1, 24)), text(own(41), " ", "sk_live_", sub(plain, 1, 24))),
        (0, digests, harmless(digests)), (0, digests, harmless(digests)), (0, identifiers, of(42, [identifiers, text(own(43), ' = "', identifiers, '"'), text("import ", identifiers)])), (0, blanks, assigned(blanks)), (0, blanks, assigned(blanks)),
        (0, keys, assigned(keys)), (0, sub(mixed, 1, 60), text("data:image/png;base64,", F.regexp_replace(sub(mixed, 1, 60), r"\s", ""))),
    ]
    made = F.array(*[F.struct(F.lit(float(y)).alias("label"), F.regexp_replace(v, r"\s", "").alias("value"), s.alias("snippet"), F.lit(i).alias("kind")) for i, (y, v, s) in enumerate(kinds)])
    rows = some.withColumn("p", F.element_at(made, draw(44, len(kinds)) + 1)).withColumn("k", draw(45, 1 << 20) % (F.size("ws") + 1))
    in_test = text("tests/", own(46), "/fixtures/", own(47), ".py")
    in_code = text("src/", own(49), "/", own(50), "/", own(47), ".py")
    where = F.when(F.col("p.kind") == 11, in_test).when(draw(48, 8) == 0, F.when((F.col("p.label") == 1) | (draw(51, 2) == 0), in_code).otherwise(in_test)).otherwise(F.col("source"))
    whole = F.concat_ws(" ", F.array_join(F.expr("slice(ws, 1, k)"), " "), "p.snippet", F.array_join(F.expr("slice(ws, k + 1, size(ws))"), " "))
    rows = materialize(rows.select("doc_id", whole.alias("text"), where.alias("source"), F.col("p.value").alias("candidate"), F.col("p.label").alias("label")), "secret-planted")
    return rows.select("doc_id", "text", "source"), rows.select("doc_id", "candidate", "label").where("candidate rlike '^.{6,}$'")


def findings(planted: DataFrame, truth: DataFrame, counts: DataFrame) -> DataFrame:
    """Labelled findings: the planted values, as the scan sees them, with FEATURES and label."""
    return featurize(candidates(planted).join(truth, ["doc_id", "candidate"]), counts)


def train(found: DataFrame, trees: int = 40, depth: int = 10):
    """A forest from labelled findings (FEATURES and label), or the share of label 1 if there is only one label."""
    own = found.select(*FEATURES, "label").where("label in (0, 1)")
    order = [F.xxhash64(*FEATURES), *map(F.col, FEATURES)]
    part = lambda y: own.where(F.col("label") == y).orderBy(*order).limit(TRAIN_FINDINGS // 2)
    sample = materialize(part(0.0).unionByName(part(1.0)), "secret-findings")
    n, ones = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        return float(ones) / n if n else 0.5
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(sample)
    return RandomForestClassifier(labelCol="label", featuresCol="_x", numTrees=trees, maxDepth=depth, maxBins=32, seed=7).fit(vectors)


def score(found: DataFrame, model) -> DataFrame:
    """Adds probability to candidates with FEATURES."""
    if isinstance(model, float):
        return found.withColumn("probability", F.lit(model))
    out = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(found))
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "prediction")


def scan(docs: DataFrame, path: str = "source", findings: DataFrame | None = None, features: bool = False) -> DataFrame:
    """Findings of all texts: doc_id, word, nth, length, secret_sha256, probability, is_secret; with features also candidate and FEATURES."""
    counts = materialize(words(docs), "secret-words")
    if findings is None:
        findings = _planted_findings(docs, path, counts)
    found = materialize(featurize(candidates(docs, path), counts), "secret-candidates")
    scored = score(found, train(findings))
    more = ["candidate", *FEATURES[1:]] if features else []
    return scored.select("doc_id", "word", "nth", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"), "probability", (F.col("probability") >= 0.5).alias("is_secret"), *more)


def _planted_findings(docs: DataFrame, path: str, counts: DataFrame) -> DataFrame:
    return findings(*plant(docs, path=path), counts)
