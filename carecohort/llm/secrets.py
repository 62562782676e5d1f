"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is what is assigned to a name that holds a secret word or quoted after it, a key
block in PEM form, a known prefix with what follows, or a run of at least 16 key characters,
whichever begins first.  The forest sees its
length, how its characters change from one to the next, how much of it dictionary words
cover, the path or source of the document and the words beside it.  It is trained from
labelled findings: given ones, or those that narrow rules settle either way.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecohort.storage import written

MIN_LENGTH = 16
#: Labelled findings used at most for training, chosen by hash.
TRAIN_FINDINGS = 20_000
TREES, DEPTH = 20, 6
SEED = 7
#: Parts of a text whose lengths are added up one by one.
RUN = 256

# Words that name secrets, words that name other long strings, words of code and prose.
SECRET_WORDS = "token|secret|passw(?:or)?d|passwd|pwd|api_?key|access_?key|auth|bearer|credential|private"
OTHER_WORDS = "commit|sha1|sha256|sha512|md5|checksum|digest|hash|uuid|guid|isbn|serial|build|revision|etag|example|order|invoice|phone|card"
DICTIONARY = (
    "the|and|that|with|this|from|have|for|not|are|was|test|example|sample|dummy|change|your|here|user|name|data|file|"
    "value|string|null|true|false|https?|www|com|org|index|page|image|static|assets|src|lib|main|version|config|"
    "default|key|token|secret|password|admin|local|host|abc|xyz|foo|bar|lorem|ipsum"
)
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|xox[abp]-|AIza|eyJ"

_KEY = r"A-Za-z0-9+/_=\-"
_NAME = r"\w.+/\-"
#: A name with a secret word, then a sign of assignment, which may follow a type (``pwd: str = ``).
_NAMED = rf"(?<![{_NAME}])(?=[{_NAME}]*?(?i:{SECRET_WORDS}))[{_NAME}]++[\"'\])]*+"
_ASSIGNED = r"[ \t]*(?::[ \t]*[\w.\[\]?|&*]+[ \t]*=(?!=)|[:!]?={1,3}>?|:(?!:))"
#: Each alternative captures what stays before the candidate, if anything, and the candidate.
_FOUND = "|".join((
    rf"({_NAMED}(?:{_ASSIGNED}\s*|[ \t]*)[A-Za-z@$]{{0,2}}([\"'`]))(?!\2)(?!-----BEGIN)([^\n]+?)(?<!\\)(?=\2)",
    rf"({_NAMED}{_ASSIGNED}[ \t]*(?i:(?:bearer|basic)[ \t]+)?[\"'`]?)(?!-----BEGIN)"
    r"([^\s\"'`;,<>]*[^\s\"'`;,<>.:)}\]])",
    r"(-----BEGIN [A-Z0-9 ]++-----(?:[\w+/=\s:,.()\\-]*?-----END [A-Z0-9 ]++-----)?)",
    rf"(?<![{_KEY}])(eyJ[{_KEY}]{{4,}}+(?:[.][{_KEY}]++){{0,2}}|(?:{PREFIXES})[{_KEY}]{{4,}}+)",
    rf"(?<![{_KEY}])([{_KEY}]{{{MIN_LENGTH},}}+)",
))
# Marks around candidates; a text's own are blanked first, which moves nothing.
_OPEN, _CLOSE = "\x01", "\x02"

FEATURES = (
    "length", "digits", "upper", "symbols", "distinct", "class_changes", "vowel_changes", "repeats",
    "dictionary", "hex_only", "digits_only", "uuid", "known_prefix", "test_path", "assigned", "quoted",
    "secret_word", "other_word",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, start (code points before it), candidate, before, after, path.

    ``before`` and ``after`` hold up to 40 and 20 characters beside it, and none of another
    candidate's mark.  One pass of the pattern marks all candidates of a text.
    """
    text = F.translate(F.col(text_col), _OPEN + _CLOSE, "  ")
    marked = F.regexp_replace(text, _FOUND, f"$1$4{_OPEN}$3$5$6$7$8{_CLOSE}")
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), path.alias("path"), F.split(marked, _OPEN).alias("_parts"))
    rows = rows.where(F.size("_parts") > 1)
    # characters of the text before each part: those before its run of parts, and those inside
    # the run.  The work stays near linear in the parts of a text.  After explode() only look-ups
    # follow: higher-order functions there would have the arrays copied for every part.
    sizes = F.transform("_parts", lambda p: F.length(F.replace(p, F.lit(_CLOSE), F.lit(""))).cast("bigint"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("_parts") - 1) / RUN).cast("int"))
    append_sum = lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n)
    zero, zeros = F.lit(0).cast("bigint"), F.array(F.lit(0).cast("bigint"))
    run = lambda k: F.slice("_sizes", k * RUN + 1, RUN)
    run_starts = F.aggregate(
        F.transform(numbers, lambda k: F.aggregate(run(k), zero, lambda total, n: total + n)), zeros, append_sum)
    inside = F.flatten(F.transform(numbers, lambda k: F.slice(F.aggregate(run(k), zeros, append_sum), 1, RUN)))
    found = rows.withColumn("_sizes", sizes).select(
        "doc_id", "path", "_parts", run_starts.alias("_run_starts"), inside.alias("_inside"))
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.size("_parts") - 1)).alias("_i"))
    found = found.select(
        "doc_id", "path",
        (F.get("_run_starts", F.floor(F.col("_i") / RUN).cast("int")) + F.get("_inside", F.col("_i"))).alias("start"),
        F.split(F.get("_parts", F.col("_i")), _CLOSE).alias("_part"),
        F.right(F.replace(F.get("_parts", F.col("_i") - 1), F.lit(_CLOSE), F.lit("")), F.lit(40)).alias("before"),
    )
    return found.select(
        "doc_id", "start", F.get("_part", F.lit(0)).alias("candidate"), "before",
        F.substring(F.get("_part", F.lit(1)), 1, 20).alias("after"), "path",
    )


def with_features(found: DataFrame) -> DataFrame:
    """Add the forest's features; ratios are shares of the candidate's characters."""
    c, n = F.col("candidate"), F.length("candidate")
    low, before = F.lower("candidate"), F.lower("before")
    share = lambda pattern, text=c: F.regexp_count(text, F.lit(pattern)) / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    changes = "(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"
    covered = 1 - F.length(F.regexp_replace(low, DICTIONARY, "")) / n
    values = {
        "length": F.least(n, F.lit(200)).cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "class_changes": share(changes),
        "vowel_changes": share("[aeiou][b-df-hj-np-tv-z]|[b-df-hj-np-tv-z][aeiou]", low),
        "repeats": share(r"(.)(?=\1)"),
        "dictionary": covered,
        "hex_only": flag(low.rlike("^[0-9a-f]+$")),
        "digits_only": flag(c.rlike("^[0-9]+$")),
        "uuid": flag(low.rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$")),
        "known_prefix": flag(c.rlike(rf"^({PREFIXES}|-----BEGIN [A-Z0-9 ]*PRIVATE KEY)")),
        "test_path": flag(F.lower("path").rlike("test|example|sample|fixture|vendor|[.]lock")),
        "assigned": flag(before.rlike(r"([:=]>?\s*([a-z@$]{0,2}[\"'`])?|(bearer|basic) +)$")),
        "quoted": flag(before.rlike("[\"'`]$")),
        "secret_word": flag(before.rlike(rf"({SECRET_WORDS})([_.\-]\w*)?[^a-z\n]{{0,20}}([a-z@$]{{0,2}}[\"'`])?$")),
        "other_word": flag(before.rlike(rf"({OTHER_WORDS})[^a-z\n]{{0,20}}$")),
    }
    return found.withColumns({f: values[f].cast("double") for f in FEATURES})


def settled_label() -> Column:
    """1 or 0 where narrow rules settle a finding, else null."""
    named = (F.col("secret_word") == 1) & (F.col("assigned") == 1)
    random = (F.col("digits") > 0.1) & (F.col("digits_only") == 0) & (F.col("distinct") > 0.2) & (F.col("repeats") < 0.3)
    plain = (F.col("digits_only") == 1) | (F.col("uuid") == 1) | (F.col("dictionary") > 0.5) | (F.col("repeats") > 0.6)
    plain = plain | F.col("candidate").rlike("^-----BEGIN ")  # private ones are settled before
    return F.when((F.col("known_prefix") == 1) | (named & random & (F.col("dictionary") < 0.3)), 1.0).when(
        plain | (F.col("other_word") == 1), 0.0)


def without_text(found: DataFrame, *labels: Column) -> DataFrame:
    """Position, length, hash and features of findings, and ``labels``; the findings' own text stays out."""
    return found.select(
        "doc_id", "start", F.length("candidate").cast("bigint").alias("n_chars"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"),
        F.xxhash64("candidate", "before", "doc_id", "start").alias("_at"), *FEATURES, *labels,
    )


def train_filter(findings: DataFrame, label: str = "label", bound: int = TRAIN_FINDINGS):
    """Forest from labelled findings as :func:`without_text` gives them; the share of label 1 if there is only one label.

    At most ``bound`` findings are used: those with the smallest hash of candidate and context.
    """
    labelled = findings.where(F.col(label).isNotNull()).select(*FEATURES, F.col(label).cast("double").alias("label"), "_at")
    sample = labelled.orderBy("_at", "label", *FEATURES).limit(bound)
    sample = written(sample.coalesce(1), "labelled_findings")
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        return max(counts, default=0.0)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(ready)


def score_findings(findings: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """Add ``score``, the forest's probability of a real secret."""
    if isinstance(model, float):
        return findings.withColumn("score", F.lit(model))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(findings)
    model = model.copy().setFeaturesCol("_features").setProbabilityCol("_share").setPredictionCol("").setRawPredictionCol("")
    return model.transform(ready).withColumn("score", vector_to_array("_share")[1]).drop("_features", "_share")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start, length, secret_sha256, score, secret.

    ``labelled`` holds findings as :func:`candidates` gives them, with ``label`` 1 or 0; without
    it the forest learns from findings that :func:`settled_label` settles.  Null and empty texts
    have no candidates; without any candidate there are no rows.  Repeated rows have findings of
    their own.  A null path is no test path.  Other columns are not read.  Very long texts are
    scanned whole.  No file holds the candidates themselves, only their hashes.
    """
    found = with_features(candidates(docs, id_col, text_col, path_col))
    found = written(without_text(found, settled_label().alias("label")), "findings")
    train = found if labelled is None else without_text(with_features(labelled), F.col("label"))
    scored = score_findings(found, train_filter(train))
    return scored.select(
        "doc_id", "start", F.col("n_chars").alias("length"), "secret_sha256",
        "score", (F.col("score") >= threshold).alias("secret"),
    )
