"""Large JSON arrays, read by byte ranges: many tasks share one file.

The text reader cuts a file into ranges and each range into segments that begin
at an opening brace; the segments of a range are put together in chunks of bounded size. Whether a chunk begins
inside a text, and how deep, depends on all before it; but what it does to either state is known from the chunk alone:

* texts: it keeps the state, turns it round, or ends in a state of its own (a raw line end closes any text, as JSON has none in texts);
* depth: it adds a number for each of the two states it may begin in.

These steps compose, so a chunk is summed up in one row and so is a range. The rows of a file, one a range, are put
together in order, and each range, then each of its chunks, knows the state it begins in. A record begins at a brace outside
texts at depth 1. Records inside a chunk are cut out there; only pieces at its borders are brought together.

Where the array is indented, a brace that stands after a comma and just as far to the right as the first record's always begins
a record. That sets the state right again after a broken one: an open text or a missing brace costs its own record
only. In an array without line ends a missing brace costs the rest of the file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.operators.joins import staged_join
from airloom.session import stage
from airloom.sources.landed import NOT_ARRAY

RANGE = ["source_file", "block"]
CHUNK = [*RANGE, "chunk"]
# The rest of a text and its end: a quote, or a line end, which is left where it stands. An escape never takes a segment's brace along.
_TEXT_END = rb'(?:[^"\\\n]++|\\(?:[^{]|(?=\{)))*+(?:"|(?=\n))'


def _joiner():
    """Segments in the reader's order, put together in chunks: those of a range that came in one batch."""

    def join(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        white = b" \t\n\x0b\f\r"
        indented = re.compile(rb"\n[ \t]+(?:\r\n|\r|\n)?\Z")

        def indent(segment):
            """White space after the last comma or bracket, where it holds a line end and an indent."""
            body = segment.rstrip(white)
            space = segment[len(body):]
            return space.decode() if body[-1:] in (b"[", b",") and indented.search(space) else None

        key, number = None, 0
        for batch in batches:
            rows, text = [], batch.column("text")
            ends = sorted({e for c in ("source_file", "block") for e in pc.run_end_encode(batch.column(c)).run_ends.to_pylist()})
            begins = [0, *ends[:-1]]
            joined = pc.binary_join(pa.ListArray.from_arrays([0, *ends], text), b"{")
            for begin, end, whole in zip(begins, ends, joined):
                here = batch.column("source_file")[begin].as_py(), batch.column("block")[begin].as_py()
                key, number = here, number + 1 if key == here else 0
                first, last, whole = text[begin].as_py(), text[end - 1].as_py(), whole.as_py()
                if key[1] == 0 and number == 0:
                    rows.append((*key, number, whole, indent(last), first.translate(None, white) == b"[", indent(first)))
                else:  # the brace in front of a segment was left out, but for the one in front of the file
                    rows.append((*key, number, b"{" + whole, indent(last), None, None))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.string()]
            names = ["source_file", "block", "chunk", "text", "indent", "is_array", "record_indent"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return join


def read_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text from one opening brace to before another, with its place; written once, as ranges depend on settings.

    The first chunk of a file also tells whether the file begins with an array, and the indent of its records.
    """
    segments = spark.read.option("lineSep", "{").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("text"),
    )
    told = "source_file string, block long, chunk long, text binary, indent string, is_array boolean, record_indent string"
    return stage(segments.mapInArrow(_joiner(), told), "chunks")


def files_of(chunks: DataFrame) -> DataFrame:
    """One row per file: whether it begins with an array, the indent of its records, and the place of its last chunk."""
    place, first = F.struct("block", "chunk"), F.struct("record_indent", "is_array")
    files = chunks.groupBy("source_file").agg(
        F.max(F.when((F.col("block") == 0) & (F.col("chunk") == 0), first)).alias("first"), F.max(place).alias("last"))
    return files.where("first IS NOT NULL").select("source_file", "first.*", "last")


def _effects():
    """Chunks to what they do to the state: see ``chunk_effects``."""

    def effects(batches):
        import pyarrow as pa

        text_end = re.compile(_TEXT_END)
        whole = re.compile(rb'\\[^{]|"' + _TEXT_END)

        def effect(text, inside):
            """Change of depth and whether a text is open at the end."""
            if inside:
                end = text_end.match(text)
                if not end:
                    return 0, True
                text = text[end.end():]
            body, quote, _ = whole.sub(b"", text).partition(b'"')
            return body.count(b"{") + body.count(b"[") - body.count(b"}") - body.count(b"]"), bool(quote)

        for batch in batches:
            found = []
            given = (batch.column(c).to_pylist() for c in ("block", "chunk", "text", "record_indent"))
            for block, chunk, text, indent in zip(*given):
                if text is None:
                    found.append((0, False, 0, False, None))
                    continue
                marks = [] if indent is None else [text.rfind(c + indent.encode() + b"{") for c in (b",", b"[")]
                if max(marks, default=-1) >= 0:  # what stands before the last reset has no effect
                    depth, still_open = effect(text[max(marks) + 1 + len(indent):], False)
                    found.append((0, still_open, 0, still_open, 1 + depth))
                else:  # a file begins outside texts
                    found.append((*effect(text, False), *(effect(text, True) if block or chunk else (0, False)), None))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
            columns = [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)]
            kept = [*CHUNK, "indent", "record_indent"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + columns, [*kept, "out_depth", "out_open", "in_depth", "in_open", "set_depth"])

    return effects


def chunk_effects(chunks: DataFrame) -> DataFrame:
    """For each chunk the change of depth and whether a text is open at its end, both where it begins outside texts (``out_``) and inside one
    (``in_``), and the depth at its end where that does not depend on its beginning (``set_depth``). Nothing follows the last chunk of a file,
    so its text is not looked at."""
    told = "source_file string, block long, chunk long, indent string, record_indent string, out_depth long, out_open boolean, in_depth long, in_open boolean, set_depth long"
    text = F.when(F.struct("block", "chunk") != F.col("last"), F.col("text")).alias("text")
    return chunks.select(*CHUNK, text, "indent", "record_indent").mapInArrow(_effects(), told)


def _begin(state: Column, e: Column) -> tuple[Column, Column, Column]:
    """(reset, inside, depth) that an entry begins in, after the state that the one before it ended in."""
    reset = F.coalesce(state["indent"] == e["record_indent"], F.lit(False))
    return reset, ~reset & state["inside"], F.when(reset, F.lit(1)).otherwise(state["depth"]).cast("long")


def _end(inside: Column, depth: Column, e: Column) -> list[Column]:
    ends = F.when(inside, e["in_open"]).otherwise(e["out_open"])
    return [
        ends.alias("inside"),
        F.coalesce(e["set_depth"], depth + F.when(inside, e["in_depth"]).otherwise(e["out_depth"])).alias("depth"), e["indent"].alias("indent"),
    ]


def _state(inside: Column, depth: Column) -> list[Column]:
    return [inside.alias("inside"), depth.cast("long").alias("depth"), F.lit(None).cast("string").alias("indent")]


def range_effects(effects: DataFrame) -> DataFrame:
    """The same columns for whole ranges, from those of their chunks."""
    entry = F.struct("chunk", *[c for c in effects.columns if c not in CHUNK])
    listed = effects.groupBy(*RANGE).agg(F.array_sort(F.collect_list(entry)).alias("_chunks"))

    def go_on(state: Column, e: Column) -> Column:
        reset, inside, depth = _begin(state, e)
        return F.struct(*_end(inside, depth, e), (state["is_set"] | reset | e["set_depth"].isNotNull()).alias("is_set"))

    for i, name in enumerate(("out", "in")):
        start = F.struct(*_state(F.lit(bool(i)), F.lit(0)), F.lit(False).alias("is_set"))
        listed = listed.withColumn(name, F.aggregate("_chunks", start, go_on))
    first = F.col("_chunks")[0]
    return listed.select(
        *RANGE, F.col("out.indent").alias("indent"), first["record_indent"].alias("record_indent"),
        *[c for name in ("out", "in") for c in (F.col(f"{name}.depth").alias(f"{name}_depth"), F.col(f"{name}.inside").alias(f"{name}_open"))],
        F.when(F.col("out.is_set"), F.col("out.depth")).alias("set_depth"),
    )


def _begins(effects: DataFrame, by: list[str], place: str, inside: Column, depth: Column) -> DataFrame:
    """``by, place, begins_inside, begins_depth``: the state each entry begins in, where the first one of its group begins in the given one."""
    entry = F.struct(place, "indent", "record_indent", "out_depth", "out_open", "in_depth", "in_open", "set_depth")
    first = F.struct(inside.alias("inside"), depth.cast("long").alias("depth"))
    listed = effects.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_entries"), F.first(first).alias("_first"))
    found = F.array().cast(f"array<struct<{place}: bigint, begins_inside: boolean, begins_depth: bigint>>")
    start = F.struct(*_state(F.col("_first.inside"), F.col("_first.depth")), found.alias("found"))

    def go_on(state: Column, e: Column) -> Column:
        _, inside, depth = _begin(state, e)
        own = F.struct(e[place].alias(place), inside.alias("begins_inside"), depth.alias("begins_depth"))
        return F.struct(*_end(inside, depth, e), F.concat(state["found"], F.array(own)).alias("found"))

    return listed.select(*by, F.inline(F.aggregate("_entries", start, go_on, lambda s: s["found"])))


def chunk_starts(effects: DataFrame) -> DataFrame:
    """The state each chunk begins in, from one row per chunk: ``source_file, block, chunk, begins_inside, begins_depth``."""
    # a row a range and file: a terabyte has some eight thousand; then a row a chunk and range
    starts = _begins(range_effects(effects), ["source_file"], "block", F.lit(False), F.lit(0))
    return _begins(staged_join(effects, starts, RANGE), RANGE, "chunk", F.col("begins_inside"), F.col("begins_depth"))


def _cutter():
    """Chunks that know the state they begin in, cut where records begin."""

    def cut(batches):
        import pyarrow as pa

        text_end = re.compile(_TEXT_END)
        # all up to the next brace or bracket outside texts; a quote found here opens a text that does not end
        step = re.compile(rb'[^"\\{}\[\]]*+(?:(?:\\[^{]|"' + _TEXT_END + rb')[^"\\{}\[\]]*+)*+([{}\[\]"\\]?)')

        def beginnings(text, at, end, depth):
            """Places between ``at``, outside texts, and ``end`` where records begin."""
            for m in step.finditer(text, at, end):
                c = m[1]
                if c == b"{":
                    if depth == 1:
                        yield m.end() - 1
                    depth += 1
                elif c == b"}" or c == b"]":
                    depth -= 1
                elif c == b"[":
                    depth += 1
                elif c == b'"':
                    return

        def pieces(text, indent, inside, depth):
            mark = None if indent is None else re.compile(rb"[,\[]" + re.escape(indent.encode()) + rb"(?=\{)")
            resets = [m.end() for m in mark.finditer(text)] if mark else []
            end, places = resets[0] if resets else len(text), []
            if inside:
                closed = text_end.match(text, 0, end)
                places += beginnings(text, closed.end(), end, depth) if closed else []
            else:
                places += beginnings(text, 0, end, depth)
            for at, end in zip(resets, [*resets[1:], len(text)]):
                places += beginnings(text, at, end, 1)
            return [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]

        for batch in batches:
            given = (batch.column(c).to_pylist() for c in ("text", "record_indent", "begins_inside", "begins_depth"))
            found = pa.array([pieces(*row) for row in zip(*given)], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CHUNK), found], [*CHUNK, "pieces"])

    return cut


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, position, text) of each record of the array files at ``path``; see ``broken_arrays`` for the others."""
    chunks = read_chunks(spark, path)
    files = files_of(chunks).where("is_array").drop("is_array")
    chunks = staged_join(chunks.drop("is_array", "record_indent"), files, ["source_file"])
    starts = chunk_starts(stage(chunk_effects(chunks), "effects"))

    begun = staged_join(chunks, starts, CHUNK).select(*CHUNK, "text", "record_indent", "begins_inside", "begins_depth")
    # pieces of a chunk: the rest of the record before it, then its own records, the last one perhaps unfinished
    pieces = stage(begun.mapInArrow(_cutter(), "source_file string, block long, chunk long, pieces array<binary>"), "pieces")
    counts = pieces.select(*CHUNK, (F.size("pieces") - 1).cast("long").alias("last"))
    before = Window.partitionBy("source_file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("last").over(before), F.lit(0)))
    numbered = staged_join(pieces, counts, CHUNK).select(*CHUNK, "last", "offset", F.posexplode("pieces").alias("record", "text"))
    numbered = numbered.withColumn("position", F.col("offset") + F.col("record") - 1)
    at_border = (F.col("record") == 0) | (F.col("record") == F.col("last"))
    whole = numbered.where(~at_border).select("source_file", "position", F.col("text").cast("string").alias("text"))
    piece = F.struct("block", "chunk", F.col("text").cast("string").alias("text"))
    joined = numbered.where(at_border).groupBy("source_file", "position").agg(F.sort_array(F.collect_list(piece)).alias("_p"))
    records = whole.unionByName(joined.select("source_file", "position", F.array_join("_p.text", "").alias("text")))
    return records.where("position >= 0").withColumn("text", _without_end(F.col("text")))


def _without_end(text: Column) -> Column:
    """Leaves out the comma after a record, or the bracket that ends the array."""
    rare = text.endswith("\u0085") | text.endswith("\u2028") | text.endswith("\u2029")  # line ends to a pattern only
    return F.when(rare, F.regexp_replace(text, r"[\s,\]]*$", "")).otherwise(F.rtrim(text, F.lit(" \t\n\x0b\f\r,]")))


def broken_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that do not begin with an array of objects, with the reason; found from their first chunk alone."""
    files = files_of(read_chunks(spark, path))
    return files.where("NOT is_array").select("source_file", F.lit(NOT_ARRAY).alias("reject_reason"))


def parse_records(records: DataFrame) -> DataFrame:
    """``record`` as VARIANT, as ``landed.typed_records`` takes it; NULL for a text that is not JSON, whose ``text`` stays.

    An element that is no object stands behind the record before it; it is a row of its own at that record's position.
    """
    elements = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<variant>")
    return records.select("*", F.explode_outer(elements).alias("record"))
