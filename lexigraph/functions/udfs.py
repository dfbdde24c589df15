"""Column functions over text: tokens, matches, folding and hashes, in Arrow batches.

Results are built as Arrow arrays, column by column, so that no row passes as an object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators.matching import MatchIndex, Node, exact, from_json, hierarchy, match, parse, render, spans
from ..operators.terms import TermIndex
from . import text as T
from .lazy import column_function
from .vocabulary import lookup as lookup_table  # noqa: F401  a view builder for ad hoc tables
from .vocabulary import spans as span_table  # noqa: F401
from .vocabulary import synonyms as synonym_table  # noqa: F401

TOKEN = "struct<id:string,text:string,x:int,y:int,normal:string>"
NODE = "struct<node:int,parent:int,pos:int,id:string,text:string,x:int,y:int,normal:string,ner:string,canon:string,type:string,ontologies:array<string>,confidence:double,depth:int>"
PARSED = f"struct<nodes:array<{NODE}>,text:string,error:struct<code:int,message:string>>"
MATCH = "struct<term:int,x:int,y:int>"
PLACED = "struct<term:int,x:int,y:int,pos:int,n:int>"

_TOKEN_TYPES = [("id", pa.string()), ("text", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("normal", pa.string())]
_NODE_TYPES = [("node", pa.int32()), ("parent", pa.int32()), ("pos", pa.int32()), *_TOKEN_TYPES, ("ner", pa.string()), ("canon", pa.string()), ("type", pa.string()), ("ontologies", pa.list_(pa.string())), ("confidence", pa.float64()), ("depth", pa.int32())]


def _list_of(rows: Sequence[Sequence[tuple] | None], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """A list-of-structs array; None is null."""
    flat = [x for row in rows for x in row or ()]
    columns = list(zip(*flat, strict=True)) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row or ()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([row is None for row in rows]))


#: Size and rows of what is worked on at once, whatever the batches: bytes of text, or elements of lists. In Python, tokens are some hundred times their text.
PART_SIZE, PART_ROWS = 1 << 19, 1 << 10


def parts(batch: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of texts or lists, each of a bounded size, or of one row."""
    sizes = pc.list_value_length(batch) if pa.types.is_nested(batch.type) else pc.binary_length(batch)
    start, size = 0, 0
    for i, n in enumerate(sizes.fill_null(0).to_pylist()):
        if i > start and (size + n > PART_SIZE or i - start >= PART_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(batch):
        yield batch.slice(start)


def by_parts(function: Callable[[pa.Array], pa.Array]) -> Callable:
    """A function of a column as one over its batches, done part by part, so that memory does not grow with batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return (function(part) for batch in batches for part in parts(batch))

    return run


def once_each(function: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """`function` of texts, equal ones of a part being worked on once."""

    def run(text: pa.Array) -> pa.Array:
        coded = text.dictionary_encode(null_encoding="encode")
        return function(text) if 2 * len(coded.dictionary) > len(text) else function(coded.dictionary).take(coded.indices)

    return run


def _strings(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """A string function as a column function; equal strings of a batch are computed once."""

    def run(column: pa.Array) -> pa.Array:
        coded = column.dictionary_encode()
        values = pa.array([None if v is None else function(v) for v in coded.dictionary.to_pylist()], pa.string())
        return pa.DictionaryArray.from_arrays(coded.indices, values).cast(pa.string())

    return column_function(F.arrow_udf, "string")(run)


STAGES = {"exact": exact, "spans": spans, "hierarchy": hierarchy}
_fold, _normal, _hash = _strings(T.fold), _strings(T.normal_form), _strings(lambda s: str(T.murmur64a(s.encode())))


def ufold(c: Column) -> Column:
    """Without accents and invisible characters; ASCII text does not reach Python."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(_fold(c))


def normal_form(c: Column) -> Column:
    return _normal(c)


def murmur64(c: Column) -> Column:
    """MurmurHash64A with seed 1, unsigned, as a decimal string."""
    return _hash(c)


def _scanned(text: pa.Array) -> tuple[list[int], list[list]]:
    """Where the tokens of each row end, and the columns of all tokens: texts, starts, ends, normal forms."""
    ends, columns = [0], [[], [], [], []]
    for t in text.to_pylist():
        own = T.scan(t)
        for into, more in zip(columns, own, strict=True):
            into += more
        ends.append(len(columns[0]))
    return ends, columns


@column_function(F.arrow_udf, f"array<{TOKEN}>")
@by_parts
@once_each
def tokenize(text: pa.Array) -> pa.Array:
    ends, (texts, xs, ys, normals) = _scanned(text)
    ids = [T.token_id(texts[k], k - a) for a, b in zip(ends, ends[1:], strict=False) for k in range(a, b)]
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip((ids, texts, xs, ys, normals), _TOKEN_TYPES, strict=True)], names=[n for n, _ in _TOKEN_TYPES])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=text.is_null())


@column_function(F.arrow_udf, "struct<words:array<string>,x:array<int>,y:array<int>,line:array<int>>")
@by_parts
@once_each
def visible(text: pa.Array) -> pa.Array:
    """Normal forms and offsets of the tokens that take a place in phrases, and the number of line breaks before each."""
    ends, columns = [0], [[], [], [], []]
    for t in text.to_pylist():
        line = 0
        for piece, x, y, normal in zip(*T.scan(t), strict=True):
            if normal:
                for into, v in zip(columns, (normal, x, y, line), strict=True):
                    into.append(v)
            elif not set(piece).isdisjoint(T.LINE_BREAKS):
                line += 1
        ends.append(len(columns[0]))
    cuts = pa.array(ends, pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(c, t)) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
    return pa.StructArray.from_arrays(lists, names=["words", "x", "y", "line"])


def flat_nodes(nodes: Sequence[Node]) -> list[tuple]:
    """All nodes of a result, parents before their members; `parent` is null at the top."""
    out: list[tuple] = []
    todo = [(t, None, i, 0) for i, t in reversed(list(enumerate(nodes)))]
    while todo:
        t, parent, pos, depth = todo.pop()
        me = len(out)
        out.append((me, parent, pos, t.id, t.text, t.x, t.y, t.normal, t.ner, t.canon, t.type, t.ontologies if t.type else None, t.confidence, depth))
        todo += [(u, me, i, depth + 1) for i, u in reversed(list(enumerate(t.tokens)))]
    return out


def parse_text(index: MatchIndex, text: str, ctr: int = 0, boundary: bool = False) -> list[Node]:
    return parse(index, text, ctr, boundary)


def parser(spark, index: MatchIndex, ctr: int = 0, line_breaks: str = "ignore", entities_only: bool = False, failfast: bool = False, with_text: bool = True) -> Callable[[Column], Column]:
    """A column function that parses text to nodes and rendered text; an error is that row's, or the query's if `failfast`.

    `entities_only` gives top-level entities without plain tokens or history, which is most of what is sent back;
    without `with_text`, nothing is rendered.
    """
    held, boundary = spark.sparkContext.broadcast(index), _boundary(line_breaks)

    @F.arrow_udf(PARSED)
    @by_parts
    @once_each
    def run(text: pa.Array) -> pa.Array:
        nodes, texts, errors = [], [], []
        for t in text.to_pylist():
            try:
                found = None if t is None else parse_text(held.value, t, ctr, boundary)
                errors.append(None)
            except EngineError as e:
                if failfast:
                    raise
                found = None
                errors.append({"code": e.code, "message": e.message})
            if found is not None and entities_only:
                nodes.append([(i, None, i, t.id, t.text, t.x, t.y, t.normal, t.ner, t.canon, t.type, t.ontologies, t.confidence, 0) for i, t in enumerate(found) if t.type])
            else:
                nodes.append(None if found is None else flat_nodes(found))
            texts.append(render(found) if with_text and found is not None else None)
        return pa.StructArray.from_arrays(
            [_list_of(nodes, _NODE_TYPES), pa.array(texts, pa.string()), pa.array(errors, pa.struct([("code", pa.int32()), ("message", pa.string())]))], names=["nodes", "text", "error"]
        )

    return run


def token_matcher(spark, index: MatchIndex, stage: str | None = None, ctr: int = 0, line_breaks: str = "ignore") -> Callable[[Column], Column]:
    """A column function over prepared tokens: all stages, or one of exact, spans and hierarchy.

    A token is a struct with id, text, x, y and normal; `ancestors` and `descendants` (arrays of strings), if it
    has them, are what a hierarchy match may put in its place. The result is as that of `parser`.
    """
    held, boundary = spark.sparkContext.broadcast(index), _boundary(line_breaks)
    if stage not in (None, "exact", "spans", "hierarchy"):
        raise EngineError(2, f"Unknown token transformation: {stage}")

    @F.arrow_udf(PARSED)
    @by_parts
    def run(tokens: pa.Array) -> pa.Array:
        nodes, texts, errors = [], [], []
        for own in tokens.to_pylist():
            found, error = None, None
            try:
                if own is not None:
                    start = [from_json({k: v for k, v in t.items() if v is not None}) for t in own]
                    found = match(held.value, start, ctr, boundary) if stage is None else STAGES[stage](held.value, start, boundary)
            except EngineError as e:
                error = {"code": e.code, "message": e.message}
            nodes.append(None if found is None else flat_nodes(found))
            texts.append(None if found is None else render(found))
            errors.append(error)
        return pa.StructArray.from_arrays(
            [_list_of(nodes, _NODE_TYPES), pa.array(texts, pa.string()), pa.array(errors, pa.struct([("code", pa.int32()), ("message", pa.string())]))], names=["nodes", "text", "error"]
        )

    return run


def term_matcher(spark, terms: Sequence[str], line_breaks: str = "ignore", places: bool = False) -> Callable[[Column], Column]:
    """A column function that finds a constant list of terms; its index is broadcast. With `places`, matches have pos and n, in words.

    A text with more matches than the limit is an error of the query, which names its limit: no match is lost unseen.
    """
    held, boundary = spark.sparkContext.broadcast(TermIndex(terms, strict=False)), _boundary(line_breaks)

    fields = [(f, pa.int32()) for f in (("term", "x", "y", "pos", "n") if places else ("term", "x", "y"))]

    @F.arrow_udf(f"array<{PLACED if places else MATCH}>")
    @by_parts
    @once_each
    def find(text: pa.Array) -> pa.Array:
        own = lambda t: held.value.places(t, boundary) if places else held.value.find(t, boundary)
        return _list_of([None if t is None else own(t) for t in text.to_pylist()], fields)

    return find


@column_function(F.arrow_udf, f"array<{MATCH}>")
def match_terms(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Finds each row's own terms in its text; rows with equal terms share an index."""
    indexes: dict[tuple, TermIndex] = {}
    for text, terms in batches:
        at = 0
        for part in parts(text):
            yield _row_terms(part, terms.slice(at, len(part)), indexes)
            at += len(part)


def _row_terms(text: pa.Array, terms: pa.Array, indexes: dict[tuple, TermIndex]) -> pa.Array:
    out: list = []
    for t, own in zip(text.to_pylist(), terms.to_pylist(), strict=True):
        if t is None or own is None:
            out.append(None)
            continue
        key = tuple(own)
        if key not in indexes:
            if len(indexes) > 1000:
                indexes.clear()
            indexes[key] = TermIndex(own, strict=False)
        out.append(indexes[key].find(t))
    return _list_of(out, [("term", pa.int32()), ("x", pa.int32()), ("y", pa.int32())])


@column_function(F.arrow_udf, "array<struct<words:array<string>,alias:boolean,length:int>>")
def term_phrases(term: pa.Array) -> pa.Array:
    """The word runs that match a term without plus signs: itself, without its final mark, with points apart."""
    rows = [None if t is None else TermIndex([t], strict=False).phrases() for t in term.to_pylist()]
    return _list_of(rows, [("words", pa.list_(pa.string())), ("alias", pa.bool_()), ("length", pa.int32())])


def _boundary(line_breaks: str) -> bool:
    if line_breaks not in ("ignore", "boundary"):
        raise EngineError(2, "line_breaks must be ignore or boundary")
    return line_breaks == "boundary"


def entities(parsed: DataFrame, column: str = "parsed") -> DataFrame:
    """Rows of top-level entities: the frame's other columns, ``canon, surface, type, x, y, ner, confidence``."""
    keep = [c for c in parsed.columns if c != column]
    rows = parsed.select(*keep, F.explode(F.col(column)["nodes"]).alias("_n")).where("_n.parent IS NULL AND _n.type IS NOT NULL")
    return rows.select(*keep, F.col("_n.canon").alias("canon"), F.col("_n.text").alias("surface"), F.col("_n.type").alias("type"), F.col("_n.x").alias("x"), F.col("_n.y").alias("y"), F.col("_n.ner").alias("ner"), F.col("_n.confidence").alias("confidence"))


def rendered(nodes: Column) -> Column:
    """The text that nodes read as: canonical forms and trimmed texts, joined by single spaces."""
    top = F.filter(nodes, lambda n: n["parent"].isNull())
    words = F.transform(top, lambda n: F.when(n["type"].isNotNull(), n["canon"]).otherwise(F.trim(n["text"])))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def source_text(text: Column, x: Column, y: Column) -> Column:
    """The part of `text` that offsets name."""
    return F.substring(text, x + 1, y - x)
