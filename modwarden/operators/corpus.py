"""Corpus preparation: dedupe, leakage, audit, splits, sampling, augmentation, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modwarden.functions import text as tx
from modwarden.operators.lexicon import INLINE_LIMIT, contains_term, rows_with_terms
from modwarden.operators.ranking import SALTS, hashed_order, rank_by_hash
from modwarden.session import materialize


def min_length(df: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    return df.filter(F.length(tx.normalize_for_dedupe(text)) >= n)


def _digest(text: str, digest: str | None) -> Column:
    return F.col(digest) if digest else tx.text_digest(text)


def dedupe_keep_first(df: DataFrame, text: str, order: str, digest: str | None = None) -> DataFrame:
    """First row of each normalised text in the order of a unique column.

    Only ``(digest, order)`` is aggregated, with map-side combining, so a text with a huge number
    of copies shrinks to one pair per task before the shuffle. ``digest`` names a column that
    already holds :func:`text_digest`. Rows of several sources, and augmented copies, get ids of
    their own from ``id_col`` of :func:`union_corpora` and :func:`augment_union`.
    """
    first = df.groupBy(_digest(text, digest).alias("_digest")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def remove_leakage(held: DataFrame, train: DataFrame, text: str = "text", digest: str | None = None) -> DataFrame:
    """Held-out rows whose normalised text does not occur in train.

    Both sides are first reduced to distinct digests; their overlap is the list of leaks. Held-out
    rows then meet that list under a salt, so the copies of one hot text are spread over many tasks.
    """
    def digests(d: DataFrame) -> DataFrame:
        return d.select(_digest(text, digest).alias("_d")).distinct()

    leaks = digests(held).join(digests(train), "_d", "left_semi")
    spread = leaks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Copies without a column that tells them apart need a random salt; a lost task draws others with the same result.
    salt = F.floor(F.rand() * SALTS).cast("int")
    keyed = held.withColumn("_d", _digest(text, digest)).withColumn("_salt", salt)
    return keyed.join(spread, ["_d", "_salt"], "left_anti").drop("_d", "_salt")


def split_overlap(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """Number of distinct normalised texts two splits share."""
    def digests(d: DataFrame) -> DataFrame:
        return d.select(tx.text_digest(text).alias("digest"))

    return digests(a).intersect(digests(b)).agg(F.count("*").alias("overlap"))


def contradictions(
    df: DataFrame, id_col: str, terms: DataFrame, text: str = "text", label: str = "label", limit: int = INLINE_LIMIT
) -> DataFrame:
    """Rows labelled clean that contain a hard term."""
    clean = df.filter(F.col(label) == 0)
    hit = contains_term(tx.normalize_for_dedupe(text), terms, limit)
    return clean.filter(hit) if hit is not None else clean.join(rows_with_terms(clean, id_col, text, terms), id_col, "left_semi")


def contradiction_audit(
    df: DataFrame, id_col: str, terms: DataFrame, text: str = "text", label: str = "label", limit: int = INLINE_LIMIT
) -> DataFrame:
    """The corpus without its provable label errors: a filter for a short list, an anti-join for a long one."""
    hit = contains_term(tx.normalize_for_dedupe(text), terms, limit)
    if hit is not None:
        return df.filter(~F.coalesce((F.col(label) == 0) & hit, F.lit(False)))
    return df.join(rows_with_terms(df.filter(F.col(label) == 0), id_col, text, terms), id_col, "left_anti")


def prepare_corpus(
    df: DataFrame, id_col: str, terms: DataFrame, copies: Column, text: str = "text", label: str = "label", seed: int | str = 42
) -> DataFrame:
    """Length filter, dedupe, audit, split, leakage check and train-only oversampling, in that order.

    Texts are read once and left behind as a digest and a mark; every shuffle after that carries
    narrow rows. The result holds the input's other columns with ``split`` and ``copy``; join it to
    the texts by id where they are needed.
    """
    hit = contains_term(tx.normalize_for_dedupe(text), terms)
    kept = min_length(df, text).withColumn("_digest", tx.text_digest(text))
    if hit is None:
        bad = rows_with_terms(df.filter(F.col(label) == 0), id_col, text, terms)
        marked = kept.join(bad.withColumn("_bad", F.lit(True)), id_col, "left")
    else:
        marked = kept.withColumn("_bad", (F.col(label) == 0) & hit)
    narrow = materialize(marked.drop(text), "corpus")
    unique = dedupe_keep_first(narrow, text, id_col, "_digest").filter(~F.coalesce("_bad", F.lit(False))).drop("_bad")
    split = materialize(stratified_split(unique, label, id_col, seed), "split")
    train = split.filter("split = 'train'")
    clean = train.unionByName(remove_leakage(split.filter("split <> 'train'"), train, text, "_digest"))
    return oversample(clean.drop("_digest"), copies)


def stratified_split(
    df: DataFrame, label: str, id_col: str, seed: int | str = 42, val: float = 0.10, test: float = 0.20
) -> DataFrame:
    """Adds ``split``: per label in shuffled order, first tenth val, next tenth test, rest train."""
    ranked = rank_by_hash(df.withColumn("_order", hashed_order(seed, id_col)), [label], "_order")
    n, at = F.col("group_size"), F.col("rank")
    return ranked.withColumn(
        "split",
        F.when(at <= F.floor(n * val), "val").when(at <= F.floor(n * test), "test").otherwise("train"),
    ).drop("_order", "rank", "group_size")


def stratified_subsample(df: DataFrame, by: Sequence[str], id_col: str, n: int, seed: int | str = 42) -> DataFrame:
    """Per stratum its share of ``n`` rows, at least one, rounded half to even."""
    ranked = rank_by_hash(df.withColumn("_order", hashed_order(seed, id_col)), by, "_order")
    total = df.agg(F.count("*").alias("t")).scalar()
    quota = F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("group_size") / total).cast("long"))
    return ranked.filter(F.col("rank") <= quota).drop("_order", "rank", "group_size")


def subsample(df: DataFrame, id_col: str, n: int, seed: int | str = 42) -> DataFrame:
    """At most ``n`` rows in seeded order."""
    return df.withColumn("_order", hashed_order(seed, id_col)).orderBy("_order").limit(n).drop("_order")


def seeded_shuffle(df: DataFrame, id_col: str, seed: int | str = 42) -> DataFrame:
    """Adds ``position``: the place of a row in a repeatable permutation."""
    ranked = rank_by_hash(
        df.withColumn("_order", hashed_order(seed, id_col)).withColumn("_all", F.lit(0)), ["_all"], "_order", "position"
    )
    return ranked.drop("_order", "_all", "group_size")


def union_corpora(
    sources: Mapping[str, tuple[DataFrame, Mapping[str, str]]], columns: Sequence[str], id_col: str | None = None
) -> DataFrame:
    """One corpus from several: columns renamed to one schema, provenance kept in ``origin``.

    With ``id_col`` ids become ``origin/id``, as two sources may number their rows alike.
    """
    out = None
    for name, (df, renames) in sources.items():
        part = df.select(*[F.col(renames.get(c, c)).alias(c) for c in columns]).withColumn("origin", F.lit(name))
        if id_col:
            part = part.withColumn(id_col, F.concat_ws("/", "origin", F.col(id_col).cast("string")))
        out = part if out is None else out.unionByName(part)
    return out


def prepare_merged(corpus: DataFrame, id_col: str, copies: Column, text: str = "text", label: str = "label", seed: int | str = 42) -> DataFrame:
    """A merged and augmented corpus, ready to train on: length filter, dedupe, split, leakage check, weights.

    Ids must be unique over sources and copies (see ``id_col`` of the functions above). After the length filter
    only digests and narrow columns are shuffled; the result lacks the text, join it back by id.
    """
    narrow = materialize(min_length(corpus, text).withColumn("_digest", tx.text_digest(text)).drop(text), "merged")
    unique = dedupe_keep_first(narrow, text, id_col, "_digest")
    split = materialize(stratified_split(unique, label, id_col, seed), "split")
    train = split.filter("split = 'train'")
    clean = train.unionByName(remove_leakage(split.filter("split <> 'train'"), train, text, "_digest"))
    return oversample(clean, copies)


def oversample(df: DataFrame, copies: Column, split: str | None = "split") -> DataFrame:
    """Rows repeated ``copies`` times, in the train split only; below one, or null, counts as once."""
    times = F.when(F.col(split) == "train", copies).otherwise(1) if split else copies
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(times.cast("int"), F.lit(1))))))


def _flag(c: Column) -> Column:
    """A condition as 0 or 1; unknown counts as not met."""
    return F.coalesce(c.cast("int"), F.lit(0))


def copies_v1(target_lang: Column) -> Column:
    """Target language twice."""
    return F.when(target_lang, 2).otherwise(1)


def copies_v2(toxic: Column, target_lang: Column) -> Column:
    """One more copy for toxic rows and one more for target-language rows, each from the original."""
    return F.lit(1) + _flag(toxic) + _flag(target_lang)


def copies_v4(thread_row: Column, toxic: Column) -> Column:
    """Thread rows doubled twice over, then toxic rows doubled."""
    return F.when(thread_row, 4).otherwise(1) * F.when(toxic, 2).otherwise(1)


def augment_union(
    df: DataFrame, matches: Column, transformed: Column, text: str, tag: str, lang: str = "lang", id_col: str | None = None
) -> DataFrame:
    """Appends transformed copies of matching rows with the same label, under a new language tag.

    With ``id_col`` (a string column) a copy's id is its original's and the tag, so that ids stay unique.
    """
    extra = df.filter(matches).withColumn(text, transformed).withColumn(lang, F.lit(tag))
    if id_col:
        extra = extra.withColumn(id_col, F.concat_ws("/", id_col, F.lit(tag)))
    return df.unionByName(extra)


def corpus_profile(df: DataFrame, dims: Sequence[str], label: str, text: str = "text") -> DataFrame:
    """Rows, toxic share and script counts for every level of a rollup, in one pass."""
    flagged = df.select(
        *dims, label, tx.has_devanagari(text).alias("_dev"), tx.has_latin(text).alias("_lat")
    )
    return flagged.rollup(*dims).agg(
        F.count("*").alias("rows"),
        F.round(F.avg(label), 6).alias("toxic_share"),
        F.count_if("_dev").alias("devanagari"),
        F.count_if("_lat").alias("latin"),
        F.count_if(F.col("_dev") & F.col("_lat")).alias("both_scripts"),
    )


def topic_profile(df: DataFrame, topic: str, label: str) -> DataFrame:
    return df.groupBy(topic).agg(F.count("*").alias("rows"), F.round(F.avg(label), 3).alias("mean_label"))


def distinct_terms(df: DataFrame, term: str, tier: str) -> DataFrame:
    return df.select(F.lower(F.trim(term)).alias("term"), tier).distinct()
