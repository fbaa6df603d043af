"""DDL, SQL literals and INSERT scripts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.functions.cells import strip
from reckon.functions.names import quoted
from reckon.operators.ranks import running_counts
from reckon.plans.catalyst import strip_comments

# Beginnings of types whose literals are written without quotes, and of text types.
NUMERIC_TYPES = ("tinyint", "smallint", "mediumint", "int", "integer", "bigint", "largeint", "float", "double", "decimal", "numeric", "boolean", "bool")
TEXT_TYPES = ("char", "varchar", "string", "text", "json", "binary", "blob")


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    quoted: bool
    nullable: bool = True
    precision: int | None = None
    scale: int | None = None


_TOKEN = re.compile(
    r"""(?P<name>`(?:[^`]|``)*` | "(?:[^"\\]|\\.|"")*") | (?P<text>'(?:[^'\\]|\\.|'')*')
      | (?P<number>\d+) | (?P<sign>[(),.;]) | (?P<word>[^\s`"'(),.;]+)""",
    re.S | re.X,
)
# First words of parts of a CREATE TABLE that are no columns.
_KEYED = ("primary", "unique", "foreign", "duplicate", "aggregate")
_PARTS = ("key", "index", "constraint", "check", "partition", "fulltext", "spatial", "exclude", "period", "like")
_OTHER_TYPES = ("date", "datetime", "time", "timestamp", "array", "map", "struct", "variant", "bit", "enum", "set", "year", "hll", "bitmap")


def _scan(ddl: str) -> list[tuple[str, str]]:
    """(kind, text) of the tokens: name (a quoted one, without its quotes), text, number, sign, word."""
    out = []
    for m in _TOKEN.finditer(strip_comments(ddl)):
        kind, t = m.lastgroup, m.group()
        out.append((kind, t[1:-1].replace(t[0] * 2, t[0]) if kind == "name" else t))
    return out


def _no_column(words: list[tuple[str, str]]) -> bool:
    """Whether the tokens of a part begin a key, an index, a constraint or a partition. A column that is
    called as such a part has a type after its name: a whole word of the types, and then its size, an
    attribute or nothing; an index has a list of names."""
    low = [t.lower() if kind == "word" else None for kind, t in words[:2]] + [None, None]
    if low[0] in _KEYED:
        return low[1] in ("key", "index") or len(words) > 1 and words[1] == ("sign", "(")
    if low[0] not in _PARTS:
        return False
    typed = low[1] in (*NUMERIC_TYPES, *TEXT_TYPES, *_OTHER_TYPES)
    listed = len(words) > 3 and words[2] == ("sign", "(") and words[3][0] in ("word", "name")
    return not typed or listed


def parse_ddl(ddl: str) -> tuple[str, list[ColumnDef]]:
    """Table name (its parts joined by points) and columns of a CREATE TABLE of any dialect; keys,
    indexes and constraints are passed by. Quoted names, texts and parentheses are told apart by one
    scan, so neither a comment nor a default is taken for structure."""
    tokens = _scan(ddl)
    low = [t.lower() if kind == "word" else "" for kind, t in tokens]
    at = next((i for i, w in enumerate(low) if w == "table" and "create" in low[max(0, i - 3) : i]), None)
    if at is None:
        raise ValueError("no CREATE TABLE with columns")
    at += 4 if low[at + 1 : at + 4] == ["if", "not", "exists"] else 1
    parts = []
    while at < len(tokens) and tokens[at] != ("sign", "("):
        if tokens[at][0] in ("name", "word", "number"):
            parts.append(tokens[at][1])
        elif tokens[at] != ("sign", "."):
            break
        at += 1
    if not parts or at >= len(tokens) or tokens[at] != ("sign", "("):
        raise ValueError("no CREATE TABLE with columns")
    pieces, depth = [[]], 0
    for token in tokens[at:]:
        depth += (token == ("sign", "(")) - (token == ("sign", ")"))
        if depth == 0:
            break
        if depth == 1 and token == ("sign", ","):
            pieces.append([])
        elif not (depth == 1 and token == ("sign", "(") and not pieces[-1]):
            pieces[-1].append(token)
    columns = []
    for piece in pieces:
        if len(piece) < 2 or piece[0][0] not in ("name", "word") or piece[1][0] != "word" or _no_column(piece):
            continue
        kind, rest = piece[1][1].lower(), piece[2:]
        close = next((i for i, t in enumerate(rest) if t == ("sign", ")")), 0) if rest[:1] == [("sign", "(")] else 0
        sizes = [int(t) for k, t in rest[:close] if k == "number"] if kind in ("decimal", "numeric") else []
        words = [t.lower() if k == "word" else "" for k, t in rest]
        nullable = ("not", "null") not in zip(words, words[1:])
        columns.append(ColumnDef(piece[0][1], kind, not kind.startswith(NUMERIC_TYPES), nullable, sizes[0] if sizes else None, (sizes[1] if len(sizes) > 1 else 0) if sizes else None))
    if not columns:
        raise ValueError("no columns in the CREATE TABLE")
    return ".".join(parts), columns


#: Digits that a floating number keeps.
FLOAT_DIGITS = 15


def literal(value: Column, column: ColumnDef, floating: bool = False) -> Column:
    """A struct (sql, error) of a text cell: the literal of its value for the column, or why there is
    none (not_a_number, out_of_range; for a floating number of more than 15 digits before the point,
    which can't be what was meant, not_exact)."""
    if floating:
        own = literal(value.cast("decimal(38,10)") if column.scale is None else value.cast("decimal(38,18)"), column)
        long = F.abs(value) >= 10.0**FLOAT_DIGITS
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        error = F.when(odd, "not_a_number").when(long, "not_exact").otherwise(own["error"])
        return F.struct(F.when(error.isNull(), own["sql"]).alias("sql"), error.alias("error"))
    s = strip(value.cast("string"))
    textual = column.type.startswith(TEXT_TYPES)
    null = value.isNull() | (s == "") | (s == "\\N")
    if not textual:
        null = null | (F.upper(s) == "NULL")
    if column.quoted:
        sql = F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.struct(F.when(null, "NULL").otherwise(sql).alias("sql"), F.lit(None).cast("string").alias("error"))
    plain = F.when(s.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    number = plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    if column.scale is not None:
        # rounded half to even at the scale, in the widest decimal, then held against the precision
        wide = plain.try_cast(f"decimal(38,{min(column.scale + 6, 18)})")
        rounded = F.bround(wide, column.scale).cast(f"decimal(38,{column.scale})")
        fits = F.abs(rounded) < F.lit("1" + "0" * (column.precision - column.scale)).cast("decimal(38,0)")
        sql, ok = rounded.cast("string"), fits
    else:
        from reckon.functions.cells import plain_number

        sql, ok = plain_number(plain), F.lit(True)
    sql = F.when(F.lower(s) == "true", "1").when(F.lower(s) == "false", "0").otherwise(sql) if column.type in ("boolean", "bool") else sql
    number = number | F.lower(s).isin("true", "false") if column.type in ("boolean", "bool") else number
    error = F.when(~null & ~number, "not_a_number").when(~null & ~F.coalesce(ok, F.lit(False)), "out_of_range")
    return F.struct(F.when(null, "NULL").when(error.isNull(), sql).alias("sql"), error.alias("error"))


def match_columns(names: list[str], columns: list[ColumnDef]) -> list[tuple[str, ColumnDef]]:
    """Pairs of a header and the DDL's column of that name, whatever their case."""
    low = [n.strip().lower() for n in names]
    if twice := sorted({n for n in low if n and low.count(n) > 1}):
        raise ValueError(f"repeated headers: {', '.join(twice)}")
    by = {c.name.lower(): c for c in columns}
    return [(n, by[n.strip().lower()]) for n in names if n.strip().lower() in by]


def unmatched(names: list[str], columns: list[ColumnDef]) -> dict[str, list[str]]:
    """headers that no column of the DDL has, and columns that no header names."""
    heads, own = {n.strip().lower() for n in names}, {c.name.lower() for c in columns}
    return {"headers": [n for n in names if n.strip().lower() not in own], "columns": [c.name for c in columns if c.name.lower() not in heads]}


def quoted_table(table: str) -> str:
    """A table's name with each of its parts quoted."""
    parts = [p for p in table.split(".") if p]
    if not parts:
        raise ValueError("no table name")
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def inserts(df: DataFrame, table: str, columns: list[ColumnDef], order: list[str], batch: int = 500) -> DataFrame:
    """batch and sql: INSERT statements of `batch` rows, rows in the order given; rows that are blank
    throughout are passed by. Statements are numbered without a single-task sort."""
    pairs = match_columns(df.columns, columns)
    if not pairs:
        raise ValueError(f"no header is a column: {unmatched(df.columns, columns)}")
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    cells = [literal(F.col(f"`{n}`"), c, n in floats) for n, c in pairs]
    fault = F.coalesce(*[F.when(x["error"].isNotNull(), F.concat(F.lit(f"{c.name}: "), x["error"])) for x, (_, c) in zip(cells, pairs)])
    row = F.concat(F.lit("("), F.concat_ws(", ", *[x["sql"] for x in cells]), F.lit(")"))
    blank = F.lit(True)
    for n, _ in pairs:
        blank = blank & (F.coalesce(strip(F.col(f"`{n}`").cast("string")), F.lit("")) == "")
    rows = df.where(~blank).select(*order, F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(row).alias("_row"), F.lit(0).alias("_g"), F.lit(1).alias("_one"))
    placed = running_counts(rows, ["_g"], order, "_one").withColumn("batch", F.floor(F.col("before") / batch))
    head = f"INSERT INTO {quoted_table(table)} ({', '.join('`' + c.name.replace('`', '``') + '`' for _, c in pairs)}) VALUES\n"
    listed = F.transform(F.array_sort(F.collect_list(F.struct("before", "_row"))), lambda x: x["_row"])  # `batch` rows at most
    return placed.groupBy("batch").agg(F.concat(F.lit(head), F.array_join(listed, ",\n"), F.lit(";")).alias("sql"))
