"""Secret scans with a random forest that removes false positives.

Candidates are all runs of at least 16 characters of keys and encodings in any word of a text, and of at least 8
where a word that names a secret and an assignment stand before them.  The forest
judges them by length, character transitions and classes, how much of them dictionary words cover, whether
they stand in a path, and by the words beside them.  It is trained on labelled findings: given ones, or the lines
of ``secret_findings``, whose forms say what is a secret.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift.llm.common import checkpointed, whole_text
from modsift.llm.secret_findings import PER_FORM, labelled_lines
from modsift.operators.scale import compute_once

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
SHORT = r"[A-Za-z0-9+/_=-]{8,}"
SPACE = r"[\x20\x09-\x0D]+"
DICTIONARY = 300  # most frequent words of 2 to 7 letters
CONTEXT = 200  # characters of text beside a candidate that it is judged by
SAMPLE = 5000  # labelled findings per class
TREES, DEPTH = 30, 8
FEATURES = ["n_chars", "transitions", "digits", "uppers", "marks", "hex", "coverage", "path", "assigned", "quoted", "named", "before_chars", "after_chars"]
# Words that name a secret.
NAMES = "token|secret|passw|pwd|api|key|auth|bearer|credential|private"
# A name of a secret with an assignment behind it, perhaps in the next word.
ASSIGNED = rf"(?i)(?:{NAMES})[A-Za-z0-9_]*[\"']?[\x20\x09-\x0D]*[=:]"


def dictionary_words(docs: DataFrame, n: int = DICTIONARY) -> list[str]:
    """The ``n`` words of 2 to 7 letters that occur most often in all texts, ties by the word."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w).between(2, 7))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").count()
    return sorted(r.w for r in counts.orderBy(F.desc("count"), "w").limit(n).collect())


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, place (word number from 0), nth (run number in the word from 0), word, candidate, before, after.

    Every run of a word is a candidate; a word that a name and an assignment go before, or that holds both, has its
    shorter runs too.  ``word`` is the candidate with what stands around it up to the runs
    beside it; ``before`` are the two words before, or the run before inside the word; ``after`` is the next
    word, or the next run inside the word.  Each of these texts is context of at most CONTEXT characters to a
    side, so that a long line without spaces is not repeated for each of its runs; candidates are whole.
    Null and empty texts have none; rows that repeat an id, or have none, give candidates of their own; other columns
    are ignored.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).where(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ASSIGNED))
    rows = compute_once(rows, "words", F.filter(F.split("text", SPACE), lambda w: w != "")).drop("text")
    near = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    sign = lambda w: w.contains("=") | w.contains(":")
    told = lambda w, i: (sign(w) | sign(near(i - 1))) & F.concat_ws(" ", near(i - 2), near(i - 1), w).rlike(ASSIGNED)
    found = F.filter(F.transform("words", lambda w, i: F.when(w.rlike(CANDIDATE) | (w.rlike(SHORT) & told(w, i)), i)), lambda i: i.isNotNull())
    tail, head = lambda t: F.right(t, F.lit(CONTEXT)), lambda t: F.left(t, F.lit(CONTEXT))
    each = F.transform(
        found,
        lambda i: F.struct(
            i.alias("place"), near(i).alias("whole"), told(near(i), i).alias("short"),
            tail(F.concat_ws(" ", tail(near(i - 2)), tail(near(i - 1)))).alias("left"), head(near(i + 1)).alias("right"),
        ),
    )
    words = rows.select("doc_id", F.inline(each))
    runs = F.when(F.col("short"), F.regexp_extract_all("whole", F.lit(SHORT), F.lit(0))).otherwise(F.regexp_extract_all("whole", F.lit(CANDIDATE), F.lit(0)))
    words = compute_once(words, "runs", runs)
    gaps = F.when(F.col("short"), F.split("whole", SHORT)).otherwise(F.split("whole", CANDIDATE))
    words = compute_once(words, "gaps", gaps).drop("whole", "short")  # one more than runs
    inside = F.transform(
        "runs",
        lambda c, k: F.struct(
            k.alias("nth"), F.concat(tail(F.get("gaps", k)), c, head(F.get("gaps", k + 1))).alias("word"), c.alias("candidate"),
            F.when(k == 0, F.col("left")).otherwise(tail(F.get("runs", k - 1))).alias("before"),
            F.coalesce(head(F.get("runs", k + 1)), F.col("right")).alias("after"),
        ),
    )
    return words.select("doc_id", "place", F.inline(inside))


def _share(text: Column, pattern: str, of: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / of


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    c, word, before = F.col("candidate"), F.col("word"), F.lower("before")
    head = F.left(word, F.position(c, word) - 1)  # what stands in front of the candidate, after the run before it
    n = F.length(c)
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    known = "|".join(sorted((w for w in dictionary if w.isascii()), key=lambda w: (-len(w), w))) or "$^"
    columns = {
        "n_chars": n.cast("double"),
        "transitions": _share(c, changes, n),
        "digits": _share(c, "[0-9]", n),
        "uppers": _share(c, "[A-Z]", n),
        "marks": _share(c, "[+/_=-]", n),
        "hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(c), known, "")) / n,
        "path": (word.rlike(r"[/\\].*[/\\]|\.[a-z]{1,5}\b") | word.contains("://")).cast("double"),
        "assigned": ((before.rlike("[=:]$") & head.rlike("^[\"'`({\\[]*$")) | head.rlike("[=:][\"'`({\\[]*$") | c.rlike("=[^=]")).cast("double"),
        "quoted": word.rlike("[\"'`]").cast("double"),
        "named": (before.rlike(NAMES) | F.lower(word).rlike(NAMES)).cast("double"),
        "before_chars": F.length("before").cast("double"),
        "after_chars": F.length("after").cast("double"),
    }
    return found.withColumns(columns)


def train_forest(findings: DataFrame, sample: int = SAMPLE):
    """Forest on at most ``sample`` findings per class of smallest hash; None without both classes.

    ``findings`` has FEATURES and label (0 or 1).
    """
    counts = {r[0]: r[1] for r in findings.where("label in (0, 1)").groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    h = F.pmod(F.xxhash64(*FEATURES, "candidate"), F.lit(1 << 20))
    parts = []
    for label, n in sorted(counts.items()):
        near = findings.where((F.col("label") == label) & (h <= min(1 << 20, (1 << 21) * sample // n + 64)))
        parts.append(near.select(*FEATURES, F.col("label").cast("double").alias("label"), h.alias("h")).orderBy("h", *FEATURES).limit(sample))
    rows = parts[0].union(parts[1]).orderBy("h", *FEATURES).coalesce(1)  # 2 * sample rows in a fixed order
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=1, labelCol="label", featuresCol="features")
    return forest.fit(checkpointed(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")))


def judged(found: DataFrame, forest) -> DataFrame:
    """Candidates with FEATURES, plus probability and is_secret; without a forest all stay, at 0.5."""
    if forest is None:
        return found.withColumn("probability", F.lit(0.5)).withColumn("is_secret", F.lit(True))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(found)
    forest = forest.copy().setFeaturesCol("__features").setProbabilityCol("__p").setRawPredictionCol("").setPredictionCol("")
    return forest.transform(ready).withColumn("probability", vector_to_array("__p")[1]).withColumn("is_secret", F.col("probability") >= 0.5).drop("__features", "__p")


def form_findings(spark, dictionary: list[str], per_form: int = PER_FORM) -> DataFrame:
    """Labelled findings of the forms: the columns of ``candidates``, form and label (1: a secret of its line)."""
    lines = spark.createDataFrame(labelled_lines(dictionary, per_form), "doc_id long, form string, text string, secrets array<string>")
    found = candidates(lines).join(F.broadcast(lines.select("doc_id", "form", "secrets")), "doc_id")  # PER_FORM lines a form
    held = F.exists("secrets", lambda s: F.contains(F.col("candidate"), s) | F.contains(s, F.col("candidate")))
    return found.withColumn("label", held.cast("int")).drop("secrets")


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Candidates of all whole texts with their probability of being a secret.

    ``findings``: labelled findings with the columns of ``candidates`` and label; by default ``form_findings``.
    Words that tie for the last place of the dictionary go by the alphabet.  An empty table gives no rows.
    """
    words = dictionary_words(docs)
    found = with_features(candidates(docs), words)
    train = form_findings(docs.sparkSession, words) if findings is None else findings
    return judged(found, train_forest(with_features(train, words)))
