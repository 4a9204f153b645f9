"""SpotSigs document fingerprints, with DataFrame functions only.

A signature is an anchor, which is a common word of one of four languages, and the CHAIN content words that follow
it; common words between them, however many, are passed over. A text's fingerprint is the sorted set of its
signatures' 32-bit hashes, joined by commas; a text without a signature uses its words instead. The likeness of two
fingerprints is their Jaccard similarity. Sets of length n are in partition floor(log(n) / log(1 / TAU)), and
sets that are alike to TAU are in the same or in neighbouring partitions. `near_duplicates` joins all fingerprints
by that: sets meet over the rarest signatures that any partner has to share, inside a partition or with the one
below, and pairs that length and the places of what they share rule out are dropped before they are compared.

The next document in descending doc_id comes from a range partitioning of the ids: lead() inside a partition, and
one row a partition for the ends. No task orders all rows.

Edge cases: a null text is empty; a text without letters or digits has an empty fingerprint, and two empty ones
have likeness 1; a row with a null doc_id has no next document, its edited text is its own start and near_next is
that to the empty text; rows that share a doc_id have the same next document, and where that has several texts the
smallest is taken; a single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.llm.common import connected_components, materialize, read, shuffle_partitions

CHAIN, TAU = 2, 0.8
#: Sets of one length partition and signature that a task compares with as many others.
BLOCK = 256
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and a to in is it that was for on are with be this by from at as an or not but "
    "le la les de des du et un une en est que qui dans pour sur par au aux "
    "der die das und ist ein eine den dem von zu mit auf im nicht als für sich "
    "el los las del que y una por con para se al lo su no es"
)


#: Ends an anchor while a text is taken apart; it is no letter or digit, so no word holds it.
MARK = "\x02"


def any_of(words: list[str]) -> str:
    """A pattern of just these words, by common beginnings, which a backtracking matcher leaves early."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    parts = [h + any_of(rest) for h, rest in heads.items() if h]
    return "" if not parts else "(?:" + "|".join(parts) + ")" + "?" * ends


def normal(text: Column) -> Column:
    """Lower-case words with single spaces, and one at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def spots(words: Column, chain: int = CHAIN) -> Column:
    """The signatures of a normal text; a MARK stands after the anchor.

    A cell is a content word with the run of anchors before it, so a run may have any length. Each cell with a run
    becomes a line with the content words that follow, and a line is taken apart only where its run has several anchors."""
    cells = F.regexp_replace(words, f"(?<= )({any_of(ANCHORS.split())}) ", f"$1{MARK}")
    link = f" (?:[^ ]*{MARK})?[^ {MARK}]+"
    found = F.regexp_extract_all(cells, F.lit(f" (?=([^ {MARK}]+{MARK}[^ ]+{link * (chain - 1)}) )"), F.lit(1))
    lines = F.regexp_replace(F.array_join(found, "\n"), f" [^ \n]*{MARK}", " ")

    def apart(line: Column) -> Column:
        # both are bound once: a run may be as long as a text
        each = F.zip_with(F.array(F.split(line, MARK)), F.array(F.substring_index(line, MARK, -1)), lambda run, last: F.transform(F.slice(run, 1, F.size(run) - 1), lambda x: F.concat(x, F.lit(MARK), last)))
        return F.when(F.substring_index(line, MARK, 2) == line, F.array(line)).otherwise(each.getItem(0))

    return F.flatten(F.transform(F.filter(F.split(lines, "\n"), lambda x: x != ""), apart))


def add_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array column out: sorted distinct hashes of the signatures of column text."""
    df = df.withColumn(f"{out}_words", normal(F.col(text))).withColumn(f"{out}_found", spots(F.col(f"{out}_words")))
    parts = F.when(F.size(f"{out}_found") > 0, F.col(f"{out}_found")).otherwise(F.filter(F.split(f"{out}_words", " "), lambda x: x != ""))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.transform(parts, lambda x: F.hash(x)))))
    return df.drop(f"{out}_words", f"{out}_found")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def length_partition(n: Column, tau: float = TAU) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1 / tau)) + 1e-9).cast("int")


def candidates(sets: DataFrame, tau: float = TAU) -> DataFrame:
    """Pairs (a, b) of rep of sets (rep, sigs, n) that may be alike to tau; every pair that is alike is among them.

    Signatures are ordered by how many sets hold them, rarest first. Sets of n and m that are alike share tau times
    the larger of n and m at least, so they share one of the first n - ceil(tau * n) + 1. A signature that is still
    in many sets is dealt into pairs of blocks, so no task holds all of its sets."""
    least = F.ceil(F.lit(tau) * F.col("n") - 1e-9)
    each = sets.select("rep", "n", least.alias("least"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often"))
    order = W.partitionBy("rep").orderBy("often", "sig")
    first = each.join(often.where("often > 1"), "sig", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    first = first.withColumn("at", F.row_number().over(order)).where("at <= n - least + 1 and often > 1")
    first = materialize(first.select("rep", "n", "sig", "at", length_partition(F.col("n"), tau).alias("part")), "prefixes")
    # a set meets those of its own partition and of the one below
    size = first.select("sig", F.explode(F.array("part", F.col("part") + 1)).alias("part")).groupBy("sig", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    upper = first.join(size, ["sig", "part"]).select("sig", "part", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), own.alias("x"), every.alias("y"))
    lower = first.select("rep", "n", "sig", "at", F.col("part").alias("home"), F.explode(F.array("part", F.col("part") + 1)).alias("part")).join(size, ["sig", "part"])
    lower = lower.select("sig", "part", "home", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), own.alias("y"), every.alias("x"))
    once = F.when(F.col("home") == F.col("part"), F.col("a") < F.col("b")).otherwise(F.lit(True))
    close = F.least("n_a", "n_b") >= F.lit(tau) * F.greatest("n_a", "n_b") - 1e-9
    met = upper.join(lower, ["sig", "part", "x", "y"]).where(once & close)
    met = met.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    # all else that they share comes after the last signature they met over
    most = F.col("met") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return met.where(most >= F.lit(tau) * (F.col("n_a") + F.col("n_b") - most) - 1e-9).select("a", "b")


def links(sets: DataFrame, tau: float = TAU) -> DataFrame:
    """(a, b, likeness) of each pair of sets (rep, sigs, n) that is alike to tau, once."""
    a = sets.select(F.col("rep").alias("a"), F.col("sigs").alias("sigs_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("sigs").alias("sigs_b"))
    return candidates(sets, tau).join(a, "a").join(b, "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("likeness")).where(F.col("likeness") >= F.lit(tau))


def near_duplicates(docs: DataFrame, tau: float = TAU) -> DataFrame:
    """(doc_id, class_id, rep_id, n_copies, n_links) of every row, by the fingerprints of all documents.

    rep_id is the smallest doc_id of the same fingerprint and n_copies how many rows have it; n_links is the number of
    other fingerprints of a likeness of tau or more; class_id is the smallest doc_id that links lead to. Texts without
    a word are copies of each other; a row without a doc_id is a class of its own, with null ids; rows that share a
    doc_id but not a fingerprint are linked through it."""
    every = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = materialize(add_signatures(every, "text", "sigs").select("doc_id", "sigs", F.sha2(fingerprint(F.col("sigs")), 256).alias("key")), "signatures")
    sets = every.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_copies"), F.first("sigs").alias("sigs"))
    # a number of its own for each set: rows that share a doc_id may have several
    sets = sets.select("key", "low", "n_copies", "sigs", F.size("sigs").alias("n"), F.monotonically_increasing_id().alias("rep"))
    sets = materialize(sets, "sets")
    found = materialize(links(sets.where("n > 0").select("rep", "sigs", "n"), tau), "links")
    n_links = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    held = every.select("doc_id", "key").distinct().join(sets.select("key", "rep"), "key").select("doc_id", "rep")
    shared = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    parts = connected_components(found.select("a", "b").union(shared))
    known = sets.join(n_links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = known.groupBy("component").agg(F.min("low").alias("class_id"))
    known = known.join(classes, "component").select("key", "class_id", F.col("low").alias("rep_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    none = F.lit(None).cast("long")
    lost = docs.where("doc_id is null").select(none.alias("doc_id"), none.alias("class_id"), none.alias("rep_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return every.select("doc_id", "key").join(known, "key").select("doc_id", "class_id", "rep_id", "n_copies", "n_links").union(lost)


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), ",")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, third): the next doc_id downwards, the first after the last; a third of the longest text."""
    n = shuffle_partitions(docs.sparkSession)
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.floor(F.max(F.length("text")) / 3).cast("int").alias("third"))
    ids = materialize(ids.repartitionByRange(n, F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "ids")
    ends = ids.groupBy("part").agg(F.max("doc_id").alias("first"))
    # one row a partition
    everywhere = W.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lead("first").over(everywhere), F.max("first").over(everywhere.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    inside = F.lead("doc_id").over(W.partitionBy("part").orderBy(F.desc("doc_id")))
    return ids.withColumn("inside", inside).join(ends, "part").select("doc_id", F.coalesce("inside", "after").alias("next_id"), "third")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures, length_partition)."""
    # a cast that does nothing would leave an alias on one side of the self join, and two different exchanges
    key = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    every = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    # the same filter on both sides of both joins, so the texts are shuffled once and that exchange is reused
    own = every.where("doc_id is not null")
    pairs = next_ids(own).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), "third")
    sent = add_signatures(own.join(pairs, "doc_id"), "text", "sigs").select(F.col("before").alias("doc_id"), F.expr("substring(text, 1, third)").alias("start"), "sigs")
    sent = sent.groupBy("doc_id").agg(F.min(F.struct("start", "sigs")).alias("next"))
    lost = every.where("doc_id is null")
    df = own.join(sent, "doc_id", "left")
    df = df.union(lost.withColumn("next", F.lit(None).cast(df.schema["next"].dataType))).withColumn("n", F.length("text").cast("long"))
    df = df.withColumn("m", F.floor(F.col("n") / 3).cast("int"))
    start = F.expr("substring(coalesce(next.start, ''), 1, m)")
    df = df.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n as int) - m)"), start))
    df = add_signatures(add_signatures(df, "text", "a"), "edited", "b").withColumn("c", F.coalesce(F.col("next.sigs"), F.array().cast("array<int>")))
    return df.select(
        "doc_id", F.col("n").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
        F.size("a").alias("n_signatures"), length_partition(F.size("a")).alias("length_partition"),
    )


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
