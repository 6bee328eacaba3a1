"""Statements to DataFrames: conditions become Column trees in the order they were parsed; Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import spatial, textindex
from sparkloom.sources import files, layout
from sparkloom.sources.catalog import Catalog
from sparkloom.sql import ast
from sparkloom.sql.validator import comparable

TOP = 10


def condition(where, columns: dict[str, ast.Column]) -> Expression:
    """The predicate. Types are settled here, never by coercion: equality across kinds is false, order across kinds an error."""
    if isinstance(where, ast.Both):
        left, right = condition(where.left, columns), condition(where.right, columns)
        return left & right if where.operator == "AND" else left | right
    column, named = columns[where.column], F.col(f"`{where.column}`")
    if column.type == "DATE":
        named = named.cast("string")
    if where.operator == "IN":
        if where.spatial:
            if column.type != "ARRAY[FLOAT]" or len(where.value[0]) < 2:
                return F.lit(False)
            return spatial.within_array(named, where.value[0], float(where.value[1]), first_two=True)
        fit = [v for v in where.value if comparable(column, v) and not isinstance(v, list)]
        return named.isin([_number(v) for v in fit]) if fit else F.lit(False)
    if where.operator == "=":
        if not comparable(column, where.value):
            return F.lit(False)
        return named == (F.array(*map(F.lit, where.value)) if isinstance(where.value, list) else F.lit(_number(where.value)))
    values = where.value if where.operator == "BETWEEN" else [where.value]
    if not all(comparable(column, v) for v in values):
        raise TypeError(f"column '{where.column}': {column.type} has no order with {where.value!r}")
    values = [_number(v) for v in values]
    return {"BETWEEN": lambda: named.between(*values), "<": lambda: named < values[0], ">": lambda: named > values[0], "<=": lambda: named <= values[0], ">=": lambda: named >= values[0]}[where.operator]()


def _number(v):
    return int(v) if isinstance(v, bool) else v


def operation(query) -> str:
    """The access path a statement takes, as one line for the operations log."""
    if isinstance(query, ast.CreateTable):
        return f"createTable({query.table})"
    if isinstance(query, ast.CreateFromFile):
        return f"createTableFromFile({query.table}, {query.path}, {query.column}, {ast.INDEXES[query.index]})"
    if isinstance(query, ast.Insert):
        return f"add({query.table}, {query.values})"
    where, t = query.where, query.table
    if isinstance(query, ast.Delete):
        return f"remove({t}, {where.column}, {where.value})" if isinstance(where, ast.Compare) else f"remove({t}, None, None)"
    if isinstance(where, ast.Compare):
        if where.operator == "=":
            return f"search({t}, {where.column}, {where.value})"
        if where.operator == "BETWEEN":
            return f"rangeSearch({t}, {where.column}, {where.value[0]}, {where.value[1]})"
        if where.spatial:
            return f"spatialRangeSearch({t}, {where.column}, {where.value[0]}, {where.value[1]})"
    return f"scanAll({t})"


def select(catalog: Catalog, query: ast.Select) -> DataFrame:
    """A lazy DataFrame. `=` on a BOW column is a ranked search of the TOP best rows; on a Hash key it reads one bucket."""
    table, where = catalog.tables[query.table], query.where
    columns = {c.name: c for c in table.columns}
    wanted = [F.col(f"`{c}`") for c in (query.columns or columns)]
    if isinstance(where, ast.Compare) and where.operator == "=" and columns[where.column].index == "BOW":
        return ranked(catalog, query.table, where.column, str(where.value)).select(*wanted)
    rows = catalog.stored(query.table)
    if where is not None:
        rows = rows.where(condition(where, columns))
        if isinstance(where, ast.Compare) and where.operator == "=" and where.column == table.key and (hint := layout.point_filter(table, where.value)) is not None:
            rows = rows.where(hint)
    return rows.select(*wanted)


def ranked(catalog: Catalog, name: str, column: str, words: str, k: int = TOP) -> DataFrame:
    """The table's rows in the order of their scores. The index is built when first asked for after a write."""
    table = catalog.tables[name]
    if table.text_index is None:
        index = textindex.TextIndex(catalog.spark, f"{catalog.root}/{name}/text", table.key, column)
        index.build(catalog.df(name))
        table.text_index = index
    best = table.text_index.search(words, k)
    return catalog.df(name).join(best, table.key).orderBy(F.desc("score"), table.key)


def execute(catalog: Catalog, query):
    """Runs a statement: a DataFrame for SELECT, a message else; raises ValueError where nothing was done."""
    if isinstance(query, ast.Select):
        return select(catalog, query)
    if isinstance(query, ast.CreateTable):
        catalog.create(query.table, query.columns)
        return f"table '{query.table}' is created"
    if isinstance(query, ast.CreateFromFile):
        columns = files.csv_columns(catalog.spark, query.path, query.column, query.index)
        good, bad = files.read_csv(catalog.spark, query.path, columns)
        catalog.create(query.table, columns)
        said, left_out = f"table '{query.table}' is created with {catalog.append(query.table, good)} rows", bad.count()
        return f"{said}; {left_out} rows could not be read" if left_out else said
    if isinstance(query, ast.Insert):
        if not catalog.insert(query.table, query.values):
            raise ValueError(f"the row was not inserted into '{query.table}': its key may be there already")
        return f"a row is inserted into '{query.table}'"
    columns = {c.name: c for c in catalog.tables[query.table].columns}
    if not catalog.delete(query.table, condition(query.where, columns)):
        raise ValueError(f"no row of '{query.table}' was deleted")
    return f"rows of '{query.table}' are deleted"
