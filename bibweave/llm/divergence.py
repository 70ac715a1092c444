"""Source divergence audit: how far the sources of a language differ in the terms they use.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Identical texts of a language are tokenised once:
they are grouped by (lang, SHA-256) with the number of copies in each source, and a term counts once per copy, in the
documents that hold it as in its occurrences. A language keeps the terms that enough of its documents hold.

Every (lang, source) gives a kept term the share p = 1 + floor(scale * (count + prior) / (N + prior * V)), exactly: products
are decimals, quotients whole numbers. A pair's distance is the sum of abs(p - q) over all kept terms. It is evaluated
sparsely: a term that neither source holds adds the same amount, so only terms held by one side (running sums over the side's
own values) and by both (a join on the term) are met. Both follow from

    distance = V d0 + A(g, h) + A(h, g) + both(g, h),     d0 = abs(g0 - h0), g0 the share of an absent term
    A(g, h) = sum over g's terms of (abs(p - h0) - d0)
    both(g, h) = sum over shared terms of (abs(p - q) - abs(p - h0) - abs(q - g0) + d0)

Defined results: null text, lang and source are empty strings. Sources without terms take part with count 0. A language that
keeps no term has distance 0 between all its sources and no terms. Rows count as often as they repeat; ids and further columns
don't matter. An empty table gives no rows. Texts are tokenised in slices, so memory is bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibweave.llm.wordbytes import LOWER, pieces, text_bytes, word_spans
from bibweave.session import persisted

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
PART = "lang string, source string, term string, uses long, docs long"
SLICE = 2 << 20
HELD = 400_000


def distinct_texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, text, copies (array of source, n): one row per distinct text of a language.

    Copies are counted from narrow rows (digest, source), combined before the shuffle; the text travels once per map task that
    holds it. Both sides come out dealt by (lang, digest), so they meet without another shuffle.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    counted = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    copies = counted.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each term's text, the terms) of slices of the texts: whole texts, or parts of one long text."""
    raw, offsets = text_bytes(texts)
    starts, ends = word_spans(raw, offsets, LETTERS)
    owner = np.searchsorted(offsets, starts, "right") - 1
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + SLICE)))
        if b < len(starts) and owner[b] != owner[a]:
            b = int(np.searchsorted(owner, owner[b]))
        size = ends[a:b] - starts[a:b]
        begin = np.concatenate(([0], np.cumsum(size)))
        data = LOWER[raw[np.arange(begin[-1]) - np.repeat(begin[:-1] - starts[a:b], size)]]
        yield owner[a:b], pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data))
        a = b


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights (whole numbers, summed as such)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(keys) else weights


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of lang, text, copies to sums per (lang, source, term): uses and docs, both weighted by the copies.

    A text longer than a slice is met in several: occurrences add up, and its terms so far are remembered, so that each counts
    its documents once.
    """
    for whole in batches:
        for batch in pieces(whole, "text", SLICE):
            langs, sources = batch.column(0).dictionary_encode(), batch.column(2).flatten().field("source").dictionary_encode()
            lang_of, source_of = np.asarray(langs.indices).astype(np.int64), np.asarray(sources.indices).astype(np.int64)
            n, at = np.asarray(batch.column(2).flatten().field("n")), np.asarray(batch.column(2).offsets).astype(np.int64)
            at = at - at[0]
            seen = {}
            for owner, terms in _slices(batch.column(1)):
                coded = terms.dictionary_encode()
                width = len(coded.dictionary)
                pair, uses = _grouped(owner * width + np.asarray(coded.indices).astype(np.int64), np.ones(len(owner), dtype=np.int64))
                row, term = pair // width, pair % width
                fresh = np.ones(len(row), dtype=np.int64)
                for i in {int(row[0]), int(row[-1])} if len(batch.column(1)[int(row[-1])].as_buffer()) > SLICE else ():
                    mine = np.flatnonzero(row == i)
                    words = coded.dictionary.take(pa.array(term[mine])).to_pylist()
                    fresh[mine] = [w not in seen.get(i, ()) for w in words]
                    seen.setdefault(i, set()).update(words)
                # every term of a text once for each source that holds the text
                many = at[row + 1] - at[row]
                spot = np.repeat(at[row] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                row, term, uses, fresh, weight = np.repeat(row, many), np.repeat(term, many), np.repeat(uses, many), np.repeat(fresh, many), n[spot]
                key = (lang_of[row] * len(sources.dictionary) + source_of[spot]) * width + term
                group, total = _grouped(key, uses * weight)
                _, docs = _grouped(key, fresh * weight)
                where = group // width
                columns = [langs.dictionary.take(pa.array(where // len(sources.dictionary))), sources.dictionary.take(pa.array(where % len(sources.dictionary)))]
                columns += [coded.dictionary.take(pa.array(group % width)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "uses", "docs"])


def _combined(parts: list[pa.RecordBatch]) -> pa.Table:
    grouped = pa.Table.from_batches(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("uses", "sum"), ("docs", "sum")])
    return grouped.rename_columns(["lang", "source", "term", "uses", "docs"])


def combined_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term_counts``, summed per task before the shuffle in a table of at most ``HELD`` keys. When it is full its rarer half is
    sent on, so that frequent terms leave a task once."""
    parts, rows = [], 0
    for part in term_counts(batches):
        parts.append(part)
        rows += part.num_rows
        if rows > 2 * HELD:
            table = _combined(parts)
            if table.num_rows > HELD:
                table = table.sort_by([("uses", "descending")])
                yield from table.slice(HELD // 2).to_batches()
                table = table.slice(0, HELD // 2)
            parts, rows = table.combine_chunks().to_batches(), table.num_rows
    if parts:
        yield from _combined(parts).to_batches()


def share(count: Column, total: Column, kept: Column, prior: int = PRIOR, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * kept)), without rounding; null where nothing is kept."""
    whole = lambda c: c.cast("decimal(24,0)")
    return F.when(kept > 0, 1 + F.call_function("div", whole(count + prior) * F.lit(scale).cast("decimal(12,0)"), whole(total + kept * prior)))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module's description."""
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    groups = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source")).distinct()
    parts = distinct_texts(docs, text_col, lang_col, source_col).mapInArrow(combined_counts, PART)
    # sums come from the tasks already; one deal by (lang, term) serves the sums of sources and of languages
    counts = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    here = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"lang_uses": F.sum("uses").over(here), "lang_docs": F.sum("docs").over(here)}).where(F.col("lang_docs") >= least_docs)
    kept = persisted(kept.select("lang", "term", "source", "uses", "lang_uses"), "kept-terms")
    # V and N of every language, N of every source: a row each
    per_source = kept.groupBy("lang", "source").agg(F.sum("uses").alias("n"), F.count("*").alias("held"))
    per_lang = kept.groupBy("lang", "term").agg(F.first("lang_uses").alias("uses")).groupBy("lang").agg(F.sum("uses").alias("lang_n"), F.count("*").alias("v"))
    zero = F.coalesce(share(F.lit(0), F.col("n"), F.col("v")), F.lit(0))
    groups = groups.join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["n", "held", "v", "lang_n"])
    groups = persisted(groups.withColumn("p0", zero), "sources")
    shares = kept.join(groups.select("lang", "source", "n", "v", "lang_n", "p0"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", "p0", share(F.col("uses"), F.col("n"), F.col("v")).alias("p"), share(F.col("lang_uses"), F.col("lang_n"), F.col("v")).alias("q"))
    shares = persisted(shares, "shares")
    return _over_used(shares, top).unionByName(_distances(groups, shares))


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", order)
    return rows.where(F.col("rank") <= top) if top else rows


def _over_used(shares: DataFrame, top: int) -> DataFrame:
    """The terms that a source uses more than its language, by the difference of the shares."""
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(over, top)


def _distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Every pair of sources of a language with its distance. The result has all pairs of sources, so a row per pair is built
    from the list of sources; documents and terms enter it as sums only."""
    here = groups.select("lang", "source", "v", "held", "p0")
    there = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("h0"))
    pairs = here.join(there, "lang").where(F.col("source") != F.col("item"))
    # A(g, h): the values of g and the h0 of all others in one order, with running sums of the values
    values = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    blank = F.lit(None)
    line = values.select("lang", "source", F.col("p").alias("x"), "m", blank.cast("string").alias("item"))
    line = line.unionByName(pairs.select("lang", "source", F.col("h0").alias("x"), F.lit(0).cast("long").alias("m"), "item"))
    upto = Window.partitionBy("lang", "source").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("lang", "source")
    sums = {"low_m": F.sum("m").over(upto), "low": F.sum(F.col("m") * F.col("x")).over(upto), "all_m": F.sum("m").over(whole), "all": F.sum(F.col("m") * F.col("x")).over(whole)}
    line = line.withColumns(sums).where("item IS NOT NULL")
    apart = (F.col("all") - F.col("low")) - F.col("x") * (F.col("all_m") - F.col("low_m")) + F.col("x") * F.col("low_m") - F.col("low")
    side = line.select("lang", "source", "item", apart.alias("apart"))
    # both(g, h), once per unordered pair
    a = shares.select("lang", "term", "source", "p", F.col("p0").alias("g0"))
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("p0").alias("h0"))
    gain = F.abs(F.col("p") - F.col("r")) - F.abs(F.col("p") - F.col("h0")) - F.abs(F.col("r") - F.col("g0")) + F.abs(F.col("g0") - F.col("h0"))
    both = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(gain).alias("both"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both"))
    held = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"))
    mirrored = side.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("apart").alias("item_apart"))
    found = pairs.join(held, ["lang", "item"]).join(side, ["lang", "source", "item"]).join(mirrored, ["lang", "source", "item"]).join(both, ["lang", "source", "item"], "left")
    value = (F.col("v") - F.col("held") - F.col("item_held")) * F.abs(F.col("p0") - F.col("h0")) + F.col("apart") + F.col("item_apart") + F.coalesce("both", F.lit(0))
    return _ranked(found.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(value, F.lit(0)).cast("long").alias("value")))
