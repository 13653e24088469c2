"""Severity-graded lexicon matching and its reports.

A lexicon is an input table ``(term, kind, lang, severity, tier)``. Small ones are compiled into
literals and matched inside each row; a larger one becomes failure-link automata that each batch of
texts runs through once. Neither shuffles or joins. A lexicon beyond the automata's bound is matched by
equi-joins on tokens and on anchor grams. All ways give the same hits for terms of any length, and a
null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden import fixed_values as fv
from modwarden.functions import text as tx
from modwarden.functions.automaton import BATCH, Automaton, utf8
from modwarden.session import materialize

LEXICON_SCHEMA = "term string, kind string, lang string, severity int, tier string"
INLINE_LIMIT = 1000
GRAM_LIMIT = 200_000
# Bytes of terms that automata may hold together, about 20 times that in a broadcast, and bytes per automaton.
AUTOMATON_BYTES, BLOCK_BYTES = 4 << 20, 1 << 20
HITS_TYPE = "array<struct<term:string,tier:string>>"


def default_lexicon_rows() -> list[tuple]:
    """The English lists, severity 5 for block and 3 for flag."""
    lists = (
        (fv.EN_BLOCK_TOKENS, "token", 5, "block"),
        (fv.EN_FLAG_TOKENS, "token", 3, "flag"),
        (fv.EN_BLOCK_PHRASES, "phrase", 5, "block"),
        (fv.EN_FLAG_PHRASES, "phrase", 3, "flag"),
    )
    return [(t, kind, "en", sev, tier) for terms, kind, sev, tier in lists for t in terms]


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_lexicon_rows(), LEXICON_SCHEMA)


def severity_tier(severity: Column | str) -> Column:
    s = tx._col(severity)
    return F.when(s >= 4, "block").when(s >= 2, "flag").otherwise("mild")


def _precedence(lexicon: DataFrame) -> DataFrame:
    """One code per term: English list first, block before flag; mild terms never match."""
    code = F.when(F.col("lang") == "en", 0).otherwise(2) + F.when(F.col("tier") == "block", 0).otherwise(1)
    return (
        lexicon.filter(F.col("tier").isin("block", "flag"))
        .groupBy("term", "kind")
        .agg(F.min(code).alias("code"))
    )


def _tier_of(code: Column) -> Column:
    return F.when(code % 2 == 0, "block").otherwise("flag")


@dataclass(frozen=True)
class CompiledLexicon:
    """A lexicon small enough to be a literal."""

    token_codes: tuple[tuple[str, int], ...]
    phrases: tuple[tuple[str, str], ...]


def compile_lexicon(lexicon: DataFrame, limit: int = INLINE_LIMIT) -> CompiledLexicon | None:
    """Literal form, or ``None`` when the table has more rows than the limit."""
    rows = lexicon.filter(F.col("tier").isin("block", "flag")).select("term", "kind", "lang", "tier").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    codes: dict[tuple[str, str], int] = {}
    for r in rows:
        code = (0 if r.lang == "en" else 2) + (0 if r.tier == "block" else 1)
        codes[r.term, r.kind] = min(code, codes.get((r.term, r.kind), code))
    found = sorted((code, term, kind) for (term, kind), code in codes.items())
    return CompiledLexicon(
        tuple((t, c) for c, t, k in found if k == "token"),
        tuple((t, "block" if c % 2 == 0 else "flag") for c, t, k in sorted(found, key=lambda x: (x[0] % 2, x[1])) if k == "phrase"),
    )


def inline_hits(norm: Column, lex: CompiledLexicon) -> Column:
    """Hits of one normalised text, tokens in text order, then phrases."""
    none = F.array().cast(HITS_TYPE)
    # Words of the collapsed text line up with the words of the text, as runs never cross a space.
    words = F.split(F.trim(norm), " ")
    variants = F.split(F.trim(tx.collapse_repeats(norm)), " ")

    def resolve(codes: Column):
        def of(z: Column) -> Column:
            first = F.coalesce(F.try_element_at(codes, z["w"]) * 2, F.lit(99))
            second = F.coalesce(F.try_element_at(codes, z["v"]) * 2 + 1, F.lit(99))
            code = F.least(first, second)
            return F.struct(
                F.when(first <= second, z["w"]).otherwise(z["v"]).alias("term"),
                F.when(F.floor(code / 2) % 2 == 0, "block").otherwise("flag").alias("tier"),
            )

        return of

    def token_hits(cand: Column) -> Column:
        codes = F.create_map(*[F.lit(x) for pair in lex.token_codes for x in pair])
        zipped = F.zip_with(words, variants, lambda w, v: F.struct(w.alias("w"), v.alias("v")))
        hit = F.filter(zipped, lambda z: F.array_contains(cand, z["w"]) | F.array_contains(cand, z["v"]))
        return F.when(F.size(cand) == 0, none).otherwise(F.transform(hit, resolve(codes)))

    found = none
    if lex.token_codes:
        terms = F.array(*[F.lit(t) for t, _ in lex.token_codes])
        found = tx.let(F.array_intersect(F.concat(words, variants), terms), token_hits)
    if lex.phrases:
        table = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(k).alias("tier")) for t, k in lex.phrases])
        found = F.concat(found, F.filter(table, lambda p: F.contains(norm, p["term"])))
    return found


def hits_action(hits: Column | str) -> Column:
    hits = tx._col(hits)
    return (
        F.when(F.exists(hits, lambda h: h["tier"] == "block"), "block")
        .when(F.size(hits) > 0, "flag")
        .otherwise("none")
    )


def match_inline(df: DataFrame, text: str, lex: CompiledLexicon) -> DataFrame:
    """Adds ``hits`` and ``lexicon_action``; one pass over the input.

    Each column is one self-contained expression with its inputs bound once, so a filter that
    Catalyst pushes through them repeats no more than one evaluation.
    """
    hits = F.coalesce(tx.let(tx.normalize_for_match(text), lambda n: inline_hits(n, lex)), F.array().cast(HITS_TYPE))
    return df.withColumn("hits", hits).withColumn("lexicon_action", tx.let(F.col("hits"), hits_action))


def term_blocks(terms: DataFrame, limit: int) -> list[list] | None:
    """Distinct rows ``(term, code)`` in blocks of bounded bytes; ``None`` when their terms have more bytes than the limit."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    if size > limit:
        return None
    blocks, held = [], BLOCK_BYTES
    for r in sorted(terms.collect()):
        if held + len(r.term.encode()) > BLOCK_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append(r)
        held += len(r.term.encode())
    return blocks


@dataclass(frozen=True)
class CompiledAutomata:
    """A lexicon of up to ``AUTOMATON_BYTES``: automata with the code of each of their terms."""

    tokens: tuple[tuple[Automaton, tuple[str, ...], np.ndarray], ...]
    phrases: tuple[tuple[Automaton, tuple[str, ...], np.ndarray], ...]


def compile_automata(lexicon: DataFrame, limit: int = AUTOMATON_BYTES) -> CompiledAutomata | None:
    """Automata of the tokens, each between two spaces, and of the phrases; ``None`` beyond the limit."""
    terms = _precedence(lexicon).filter("term != ''")
    # A token with a space in it meets no token of a text.
    kinds = [terms.filter("kind = 'token' and not contains(term, ' ')"), terms.filter("kind = 'phrase'")]
    blocks = [term_blocks(k.select("term", "code"), limit // 2) for k in kinds]
    if None in blocks:
        return None

    def compiled(rows: list, side: str) -> tuple:
        names = tuple(r.term for r in rows)
        return Automaton([f"{side}{t}{side}" for t in names]), names, np.array([r.code for r in rows], np.int64)

    return CompiledAutomata(*(tuple(compiled(rows, side) for rows in b) for b, side in zip(blocks, (" ", ""), strict=True)))


def _batch_hits(words: pa.Array, variants: pa.Array, norm: pa.Array, automata: CompiledAutomata) -> pa.Array:
    """Hits of each text of a batch, in the order of :func:`inline_hits`."""
    names: list[str] = []
    best: list[np.ndarray] = []
    for variant, (data, offsets) in enumerate(map(utf8, (words, variants))):
        blanks = np.append(0, np.cumsum(data == 32))
        base = 0
        for automaton, terms, codes in automata.tokens:
            row, at, term = automaton.find(data, offsets)
            # Words are told apart by the spaces before them; the forms of one word stand in one place.
            best.append(np.stack([row, blanks[at] - blanks[offsets[row]], 2 * codes[term] + variant, base + term]))
            base += len(terms)
    names += (t for _, terms, _ in automata.tokens for t in terms)
    row, place, rank, term = np.concatenate(best, axis=1) if best else np.zeros((4, 0), np.int64)
    order = np.lexsort((rank, place, row))
    row, place, rank, term = row[order], place[order], rank[order], term[order]
    first = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])) if len(row) else np.zeros(0, bool)
    parts = [np.stack([row, np.zeros_like(row), place, rank // 2 % 2, term])[:, first]]
    data, offsets = utf8(norm)
    for automaton, terms, codes in automata.phrases:
        row, _, term = automaton.find(data, offsets)
        row, term = np.divmod(np.unique(row * len(terms) + term), len(terms))
        # Phrases lie in the order of their terms, block by block.
        parts.append(np.stack([row, np.ones_like(row) + codes[term] % 2, len(names) + term, codes[term] % 2, len(names) + term]))
        names += terms
    row, _, _, flag, term = (all_ := np.concatenate(parts, axis=1))[:, np.lexsort(all_[2::-1])]
    found = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(term)), pa.array(["block", "flag"]).take(pa.array(flag))], ["term", "tier"])
    bounds = np.append(0, np.cumsum(np.bincount(row, minlength=len(norm)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)


def _in_slices(columns: Sequence[pa.Array], run) -> pa.Array:
    """The results of a batch, run over a bounded number of bytes at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH, "right")))
        out.append(run(*(c.slice(at, end - at) for c in columns)))
        at = end
    return pa.concat_arrays(out)


def match_by_automaton(df: DataFrame, text: str, automata: CompiledAutomata) -> DataFrame:
    """Same columns as :func:`match_inline`, for a lexicon too long for literals; one pass over the input."""
    shared = df.sparkSession.sparkContext.broadcast(automata)

    @F.arrow_udf(HITS_TYPE)
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for norm, variants in batches:
            if not len(norm):
                continue

            def run(n: pa.Array, v: pa.Array) -> pa.Array:
                spaced = (pc.binary_join_element_wise("", pc.utf8_trim(x, " "), "", " ") for x in (n, v))
                return _batch_hits(*spaced, n, shared.value)

            yield _in_slices([norm, variants], run)

    norm = F.coalesce(tx.normalize_for_match(text), F.lit(""))
    named = df.withColumn("hits", tx.let(norm, lambda n: F.struct(n.alias("n"), tx.collapse_repeats(n).alias("v"))))
    return named.withColumn("hits", found(F.col("hits.n"), F.col("hits.v"))).withColumn("lexicon_action", tx.let(F.col("hits"), hits_action))


def holds_term(norm: Column, terms: DataFrame, limit: int = AUTOMATON_BYTES) -> Column | None:
    """Whether a normalised text holds any of a long list of terms; ``None`` beyond the limit of the automata."""
    blocks = term_blocks(terms.select("term").filter("term != ''").distinct(), limit)
    if blocks is None:
        return None
    shared = terms.sparkSession.sparkContext.broadcast([Automaton([r.term for r in rows]) for rows in blocks])

    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(x: pa.Array) -> pa.Array:
            data, offsets = utf8(x)
            hit = np.zeros(len(x), bool)
            for automaton in shared.value:
                hit[automaton.find(data, offsets)[0]] = True
            return pa.array(hit, mask=x.is_null().to_numpy(zero_copy_only=False))

        for text in batches:
            if len(text):
                yield _in_slices([text], run)

    return holds(norm)


def token_hit_rows(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """One row per token that hits ``(id, pos, term, tier)``, by an equi-join on the token."""
    norm = df.select(id_col, tx.normalize_for_match(text).alias("_norm"))
    words = norm.select(
        id_col,
        F.posexplode(
            F.zip_with(
                F.split(F.trim("_norm"), " "),
                F.split(F.trim(tx.collapse_repeats("_norm")), " "),
                lambda w, v: F.array_distinct(F.array(w, v)),
            )
        ).alias("pos", "_forms"),
    )
    forms = words.select(id_col, "pos", F.posexplode("_forms").alias("variant", "term")).filter("term != ''")
    terms = _precedence(lexicon).filter("kind = 'token'").select("term", "code")
    best = (
        forms.join(terms, "term")
        .groupBy(id_col, "pos")
        .agg(F.min(F.struct(F.col("code") * 2 + F.col("variant"), "term", "code")).alias("m"))
    )
    return best.select(id_col, "pos", "m.term", _tier_of(F.col("m.code")).alias("tier"))


def grams(c: Column | str, q: int) -> Column:
    """Distinct character grams of a text, read in one scan by an overlapping look-ahead."""
    return F.array_distinct(F.regexp_extract_all(tx._col(c), F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def substring_matches(df: DataFrame, id_col: str, text: str, terms: DataFrame, q: int) -> DataFrame:
    """``(id, <columns of terms>)`` for each term that the text column contains.

    Exact, with no pairwise comparison: a term can only occur where its first ``q`` characters do,
    or all of a shorter term, so texts and terms meet on that anchor, as narrow rows of id and gram,
    and only the candidates that come out are looked up in their texts. Grams that no term begins
    with leave before the shuffle when the anchors, counted first, are few enough to be broadcast.
    """
    anchored = terms.filter("term != ''").withColumn("_gram", F.substring("term", 1, q))
    anchors = materialize(anchored.select("_gram").distinct(), "anchors")
    known = anchors.agg(F.count("*").alias("n"), F.collect_set(F.length("_gram")).alias("sizes")).first()
    cut = df.select(id_col, F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *(grams(text, n) for n in known["sizes"])))).alias("_gram"))
    if known["n"] <= GRAM_LIMIT:
        cut = cut.join(F.broadcast(anchors), "_gram", "left_semi")
    candidates = cut.join(anchored, "_gram").select(id_col, *terms.columns)
    texts = df.select(id_col, F.col(text).alias("_text"))
    found = texts.join(candidates, id_col).filter(F.contains(F.col("_text"), F.col("term")))
    return found.select(id_col, *terms.columns)


def phrase_hit_rows(df: DataFrame, id_col: str, text: str, lexicon: DataFrame, q: int = 3) -> DataFrame:
    norm = df.select(id_col, tx.normalize_for_match(text).alias("_norm"))
    terms = _precedence(lexicon).filter("kind = 'phrase'").select("term", _tier_of(F.col("code")).alias("tier"))
    return substring_matches(norm, id_col, "_norm", terms, q)


def match_by_join(df: DataFrame, id_col: str, text: str, lexicon: DataFrame, q: int = 3) -> DataFrame:
    """Same columns as :func:`match_inline`, for lexicons of any size. ``id_col`` is unique."""
    rows = token_hit_rows(df, id_col, text, lexicon).unionByName(
        phrase_hit_rows(df, id_col, text, lexicon, q).withColumn("pos", F.lit(None).cast("int"))
    )
    last = F.coalesce("pos", F.lit(2147483647))
    hits = rows.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(last.alias("pos"), "tier", "term"))).alias("_hits")
    )
    shaped = F.transform("_hits", lambda h: F.struct(h["term"].alias("term"), h["tier"].alias("tier")))
    return (
        df.join(hits, id_col, "left")
        .withColumn("hits", F.coalesce(shaped, F.array().cast(HITS_TYPE)))
        .drop("_hits")
        .withColumn("lexicon_action", hits_action("hits"))
    )


def lexicon_verdicts(
    df: DataFrame, id_col: str, text: str, lexicon: DataFrame, limit: int = INLINE_LIMIT
) -> DataFrame:
    """``hits`` and ``lexicon_action`` (block, flag, none) per row; the size of the lexicon decides how."""
    lex = compile_lexicon(lexicon, limit)
    if lex:
        return match_inline(df, text, lex)
    automata = compile_automata(lexicon)
    return match_by_automaton(df, text, automata) if automata else match_by_join(df, id_col, text, lexicon)


def lexicon_profile(lexicon: DataFrame) -> DataFrame:
    """Distinct terms per list and tier, and how many stand in more than one tier of a kind."""
    tiers = F.collect_set("tier")
    per_term = lexicon.groupBy("kind", "lang", "term").agg(tiers.alias("tiers"))
    return (
        per_term.select("kind", "lang", "term", F.explode("tiers").alias("tier"), F.size("tiers").alias("n"))
        .groupBy("kind", "lang", "tier")
        .agg(F.count("*").alias("terms"), F.sum((F.col("n") > 1).cast("long")).alias("in_other_tiers"))
    )


def lexicon_label_audit(verdicts: DataFrame, label: str) -> DataFrame:
    """Gold label against lexicon outcome."""
    return verdicts.groupBy(label).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("lexicon_action") == "block").alias("block"),
        F.count_if(F.col("lexicon_action") == "flag").alias("flag"),
        F.count_if(F.col("lexicon_action") == "none").alias("none"),
    )


def contains_term(norm: Column, terms: DataFrame, limit: int = INLINE_LIMIT) -> Column | None:
    """Whether a normalised text holds any term: a plain predicate, or automata for a long list. ``None`` beyond both."""
    found = [r.term for r in terms.select("term").limit(limit + 1).collect()]
    if len(found) > limit:
        return holds_term(norm, terms)
    literal = F.array(*[F.lit(t) for t in sorted(set(found))]).cast("array<string>")
    return tx.let(norm, lambda n: F.exists(literal, lambda t: F.contains(n, t)))


def rows_with_terms(df: DataFrame, id_col: str, text: str, terms: DataFrame, q: int = 3) -> DataFrame:
    """Ids of the rows whose dedupe-normalised text holds any of the terms, for lists of any length."""
    norm = df.select(id_col, tx.normalize_for_dedupe(text).alias("_norm"))
    return substring_matches(norm, id_col, "_norm", terms.select("term").distinct(), q).select(id_col).distinct()
