"""Document ETL: elements of pages to repaired sentences, sections, page runs, documents and chunks.

An element has (source, seq, category, page_number, text); ``seq`` orders the elements of a source.
Every step is a change flag by the element before and a running count of flags.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import has_sentence_end
from quire.functions.tokenizers import count_tokens
from quire.plans.storage import durable


def _running(flag: Column, *by: str, order: str = "seq") -> Column:
    w = W.partitionBy(*by).orderBy(order)
    return F.sum(flag.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))


def fix_dangling_sentences(elements: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Elements whose sentence goes on in the next are joined with it by a blank.

    An element is appended to the one before if it is narrative or ends a sentence itself, and the one
    before is narrative and does not end a sentence. Only the neighbour matters: what is appended and
    not narrative has ended a sentence. Category, page and the columns ``carry`` are the first element's.
    """
    w = W.partitionBy("source").orderBy("seq")
    narrative, ends = F.col("category") == "NarrativeText", has_sentence_end("text")
    before = F.lag(narrative & ~ends).over(w)
    flagged = elements.withColumn("merged", F.coalesce((narrative | ends) & before, F.lit(False)))
    runs = flagged.withColumn("run", _running(~F.col("merged"), "source"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return runs.groupBy("source", "run").agg(
        F.min("seq").alias("seq"), F.min_by("category", "seq").alias("category"), F.min_by("page_number", "seq").alias("page_number"),
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
        *[F.min_by(c, "seq").alias(c) for c in carry],
    ).drop("run")


def sections(elements: DataFrame, every_title: bool = False) -> DataFrame:
    """Adds ``section`` (from 0): a title opens one, unless it follows a title (with ``every_title``: always)."""
    title = F.col("category") == "Title"
    before = F.lag(title).over(W.partitionBy("source").orderBy("seq"))
    opens = before.isNull() | (title if every_title else title & ~before)
    return elements.withColumn("section", _running(opens, "source") - 1)


def page_runs(sectioned: DataFrame) -> DataFrame:
    """Adds ``page_run`` (from 0): neighbouring sections whose first elements are of one page. A page that comes again is a run of its own."""
    w = W.partitionBy("source", "section").orderBy("seq")
    first = F.coalesce(F.first("page_number").over(w), F.lit(-1))
    paged = sectioned.withColumn("section_page", first)
    change = F.col("section_page") != F.lag("section_page").over(W.partitionBy("source").orderBy("seq"))
    return paged.withColumn("page_run", _running(F.coalesce(change, F.lit(True)), "source") - 1).drop("section_page")


def page_documents(paged: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(source, page_run, page_number, text): elements joined by newlines, sections by blank lines; a missing page is -1. Columns ``carry`` are those of the first element."""
    lines = F.array_sort(F.collect_list(F.struct("seq", "text")))
    by_section = paged.groupBy("source", "page_run", "section").agg(
        F.array_join(F.transform(lines, lambda p: p["text"]), "\n").alias("text"), F.min("seq").alias("seq"), F.min_by("page_number", "seq").alias("page_number"),
        *[F.min_by(c, "seq").alias(c) for c in carry],
    )
    parts = F.array_sort(F.collect_list(F.struct("section", "text")))
    return by_section.groupBy("source", "page_run").agg(
        F.coalesce(F.min_by("page_number", "seq"), F.lit(-1)).alias("page_number"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"),
        *[F.min_by(c, "seq").alias(c) for c in carry],
    )


def elements_to_documents(elements: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The whole chain: repair, sections, page runs, documents; ``carry``: more columns of the first element of a document."""
    return elements.transform(fix_dangling_sentences, carry).transform(sections).transform(page_runs).transform(page_documents, carry)


def file_documents(elements: DataFrame) -> DataFrame:
    """One document a source, without pages."""
    lines = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return elements.groupBy("source").agg(F.array_join(F.transform(lines, lambda p: p["text"]), "\n\n").alias("text"))


def token_chunks(docs: DataFrame, tokens: Column, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` tokens, ``overlap`` of them shared with the next: adds chunk_index and chunk. A chunk's row carries its own text, not the tokens of the whole."""
    step = size - overlap
    n = F.size("_tokens")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / F.lit(step)).cast("int") - 1))).otherwise(F.array().cast("array<int>"))
    joined = F.transform(starts, lambda i: F.array_join(F.slice("_tokens", i * step + 1, size), " "))
    return docs.withColumn("_tokens", tokens).select(*docs.columns, F.posexplode(joined).alias("chunk_index", "chunk"))


def chunk_index(chunks: DataFrame, order: str, source: str = "source") -> DataFrame:
    """Adds ``chunk_index``, which starts anew whenever the source differs from the row before; order is within ``part``, a column that partitions the input.

    The rows are written in ranges of (part, order), numbered within each, and a run that began in an
    earlier range is carried on; so a part may be larger than a task. Null parts and null sources are
    values as others; rows of equal part and order meet in one range, in no fixed order.
    """
    ranged = durable(chunks.repartitionByRange("part", order).withColumn("_range", F.spark_partition_id()), "chunk-ranges")
    w = W.partitionBy("part", "_range").orderBy(order)
    starts = (F.row_number().over(w) == 1) | ~F.col(source).eqNullSafe(F.lag(source).over(w))
    runs = ranged.withColumn("_starts", starts).withColumn("_run", _running(F.col("_starts"), "part", "_range", order=order)).drop("_starts")
    placed = runs.withColumn("_place", F.row_number().over(W.partitionBy("part", "_range", "_run").orderBy(order)))

    last = F.max(F.struct("_run", "_place")).alias("last")
    ends = placed.groupBy("part", "_range").agg(F.min_by(source, "_run").alias("first_source"), F.max_by(source, "_run").alias("last_source"), last)
    by_range = W.partitionBy("part").orderBy("_range")  # a row a range
    before = F.lag("last_source").over(by_range)
    joins = (F.row_number().over(by_range) > 1) & F.col("first_source").eqNullSafe(before)
    chained = ends.withColumn("joins", joins).withColumn("chain", _running(~(F.col("joins") & (F.col("last._run") == 1)), "part", order="_range"))
    chained = chained.withColumn("length", F.sum("last._place").over(W.partitionBy("part", "chain").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)))
    carried = chained.withColumn("_before", F.when(F.col("joins"), F.lag("length").over(by_range))).where("_before > 0")
    # ranges do not overlap, so only the first part of each can go on: at most a row a range is sent
    carried = F.broadcast(carried.select(F.col("part").alias("_part"), F.col("_range").alias("_of"), "_before"))
    joined = placed.join(carried, F.col("part").eqNullSafe(F.col("_part")) & (F.col("_range") == F.col("_of")) & (F.col("_run") == 1), "left")
    index = (F.col("_place") - 1 + F.coalesce("_before", F.lit(0))).cast("int")
    return joined.withColumn("chunk_index", index).drop("_range", "_run", "_place", "_part", "_of", "_before")


def fix_metadata(docs: DataFrame, column: str = "metadata") -> DataFrame:
    """A map's values as text, a missing one as ``None``."""
    return docs.withColumn(column, F.transform_values(column, lambda _, v: F.coalesce(v.cast("string"), F.lit("None"))))


def typed_metadata(docs: DataFrame, column: str = "metadata") -> DataFrame:
    """JSON text as a variant, whose values keep their types; text that is no JSON becomes a variant string of itself, and null stays."""
    parsed = F.try_parse_json(column)
    return docs.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce(parsed, F.parse_json(F.to_json(F.struct(F.col(column).alias("text"))))).cast("variant")))


def metadata_value(column: Column | str, path: str, kind: str) -> Column:
    """The value at a path of a variant (``$.device.os``) as ``kind``; null where there is none or it is of another kind."""
    return F.try_variant_get(column, path, kind)


def metadata_primitives(column: Column | str, keys: Sequence[str]) -> Column:
    """A variant's values of some keys as an array of struct(key, kind, value): numbers, booleans and text stay as they are, all else, null too, is text; a missing key is left out."""
    column = F.col(column) if isinstance(column, str) else column

    def one(key: str) -> Column:
        # null for a missing key, a variant null for one that holds null
        found = F.try_variant_get(column, f"$.{key}", "variant")
        kind = F.lower(F.schema_of_variant(found))
        text = F.when(F.is_variant_null(found), F.lit("None")).when(kind == "string", F.try_variant_get(found, "$", "string")).otherwise(F.to_json(found))
        return F.when(found.isNotNull(), F.struct(F.lit(key).alias("key"), kind.alias("kind"), text.alias("value")))

    return F.filter(F.array(*map(one, keys)), lambda x: x.isNotNull())


#: Where texts are cut, the coarsest first.
SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursively(text: str, size: int, overlap: int, length=len, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size``, cut at the coarsest separator that a text has, finer ones where a piece is too long.

    Neighbouring pieces are merged up to ``size``; each chunk begins with pieces of the one before that
    make up at most ``overlap``.
    """
    separator = next((s for s in separators if s in text), "")
    finer = separators[separators.index(separator) + 1 :]
    pieces = [p for p in (text.split(separator) if separator else list(text)) if p]
    out: list[str] = []
    fitting: list[str] = []

    def flush() -> None:
        out.extend(_merged(fitting, separator, size, overlap, length))
        fitting.clear()

    for piece in pieces:
        if length(piece) <= size or not finer:
            fitting.append(piece)
        else:
            flush()
            out.extend(split_recursively(piece, size, overlap, length, finer))
    flush()
    return out


def _uncut(text: str, size: int) -> list[str] | None:
    """What ``split_recursively`` makes of a text of at most ``size`` characters, where no piece is longer than its characters; None for others.

    A text with empty pieces is left to it, too, as it drops them.
    """
    separator = next((s for s in SEPARATORS if s in text), "")
    if len(text) > size or separator and separator * 2 in text:
        return None
    return [bare] if (bare := text.strip()) else []


def _merged(pieces: Sequence[str], separator: str, size: int, overlap: int, length) -> Iterator[str]:
    gap, held, total = length(separator), [], 0
    for piece in pieces:
        n = length(piece)
        if held and total + gap + n > size:
            if text := separator.join(held).strip():
                yield text
            while held and (total > overlap or total + gap + n > size):
                total -= length(held[0]) + (gap if len(held) > 1 else 0)
                held.pop(0)
        total += n + (gap if held else 0)
        held.append(piece)
    if text := separator.join(held).strip():
        yield text


#: Bytes of text that are split at once, about; a text of more is alone.
PART_BYTES = 1 << 20


def parts_of(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch with ``PART_BYTES`` of text or less, so that a batch's rows, however many or long, are not all split at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PART_BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


def recursive_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, by: str = "characters", tokenizer: str | None = None) -> DataFrame:
    """Adds chunk_index and chunk; ``by``: characters or tokens (of a tokenizer file that all executors can read, else words between white space)."""
    length = len if by == "characters" else count_tokens(tokenizer)
    few = by == "characters" or tokenizer is None  # words are no more than characters

    def chunks_of(text: str | None) -> list[str]:
        whole = _uncut(text or "", size) if few or not text else None
        return split_recursively(text, size, overlap, length) if whole is None else whole

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in parts_of(texts):
                yield pa.array([chunks_of(t) for t in part.to_pylist()], pa.list_(pa.string()))

    return docs.select("*", F.posexplode(split("text")).alias("chunk_index", "chunk"))
