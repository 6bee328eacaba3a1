"""Tables as snapshots of Parquet: every write makes new files and then moves the pointer, so readers never see half a write."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources import layout
from sparkloom.sql.ast import Column

SPARK_TYPES = {"INT": T.IntegerType(), "FLOAT": T.DoubleType(), "VARCHAR": T.StringType(), "DATE": T.StringType(), "ARRAY[FLOAT]": T.ArrayType(T.DoubleType())}
POSITION = "_pos"


def schema_of(columns: list[Column]) -> T.StructType:
    return T.StructType([T.StructField(c.name, SPARK_TYPES[c.type], True, {"key": c.is_key, "index": c.index or "", "size": c.size or 0}) for c in columns])


def columns_of(schema: T.StructType, key: str, index: str | None = None) -> list[Column]:
    """Columns of the dialect for Parquet that is there already."""

    def kind(t: T.DataType) -> str:
        if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            return "INT"
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            return "FLOAT"
        if isinstance(t, T.ArrayType):
            return "ARRAY[FLOAT]"
        return "DATE" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "VARCHAR"

    return [Column(f.name, kind(f.dataType), None, f.name == key, index if f.name == key else None) for f in schema.fields]


def with_positions(df: DataFrame, start: int = 0) -> DataFrame:
    """Adds _pos, counted from `start` in the order of the rows; partitions' counts are all that reaches the driver."""
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = sorted(tuple(r) for r in marked.groupBy(part.alias("p")).count().collect())
    at, offsets = start, []
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(at)]
        at += n
    if not offsets:
        return df.withColumn(POSITION, F.lit(start).cast("long"))
    return marked.withColumn(POSITION, (F.element_at(F.create_map(*offsets), part) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_id")


@dataclass
class Table:
    name: str
    columns: list[Column]
    structure: str
    paths: list[str] = field(default_factory=list)
    rows: int = 0
    next_pos: int = 0
    source: DataFrame | None = None  # read-only tables that are there already
    text_index: object = None

    @property
    def key(self) -> str:
        return next(c.name for c in self.columns if c.is_key)


class Catalog:
    """In memory, as its tables' metadata are lost with it; files stand under `root`."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='tables-')}/{uuid.uuid4().hex}"
        self.tables: dict[str, Table] = {}

    # definitions

    def create(self, name: str, columns: list[Column], structure: str | None = None) -> Table:
        if not any(c.is_key for c in columns):
            raise ValueError("a table needs a KEY column")
        self.tables[name] = Table(name, columns, structure or layout.choose(columns))
        return self.tables[name]

    def register(self, name: str, df: DataFrame, key: str, index: str | None = None, structure: str | None = None) -> Table:
        """A read-only table over a DataFrame."""
        columns = columns_of(df.schema, key, index)
        self.tables[name] = Table(name, columns, structure or layout.choose(columns), source=df)
        return self.tables[name]

    def drop(self, name: str) -> bool:
        """Forgets a table and deletes its files by the file system that holds them."""
        table = self.tables.pop(name, None)
        for p in table.paths if table else []:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return table is not None

    # reads

    def stored(self, name: str) -> DataFrame:
        """The rows with _pos, and with what the layout adds."""
        table = self.tables[name]
        if table.source is not None:
            return table.source
        if not table.paths:
            return self.spark.createDataFrame([], layout.stored_schema(schema_of(table.columns), table))
        return self.spark.read.schema(layout.stored_schema(schema_of(table.columns), table)).parquet(*table.paths)

    def df(self, name: str) -> DataFrame:
        return self.stored(name).select(*[F.col(f"`{c.name}`") for c in self.tables[name].columns])

    def scan(self, name: str, ordered: bool = False) -> DataFrame:
        """All rows; in key order for the ordered structures, else in the order of insertion, if asked for."""
        table, rows = self.tables[name], self.stored(name)
        if ordered and table.structure in layout.ORDERED:
            rows = rows.orderBy(table.key)
        elif ordered and table.source is None:
            rows = rows.orderBy(POSITION)
        return rows.select(*[F.col(f"`{c.name}`") for c in table.columns])

    def read_at(self, name: str, pos: int) -> DataFrame:
        """The row at an ordinal position; ValueError out of range."""
        table = self.tables[name]
        if not 0 <= pos < table.next_pos:
            raise ValueError(f"no position {pos}")
        return self.stored(name).where(F.col(POSITION) == pos).select(*[F.col(f"`{c.name}`") for c in table.columns])

    def count(self, name: str) -> int:
        return self.df(name).count()

    def preview(self, name: str, limit: int = 100) -> tuple[DataFrame, bool]:
        """The first rows and whether there are more."""
        rows = self.df(name)
        return rows.limit(limit), rows.limit(limit + 1).count() > limit

    # writes

    def _write(self, table: Table, rows: DataFrame, fresh: bool) -> None:
        path = f"{self.root}/{table.name}/{uuid.uuid4().hex}"
        layout.write(rows, table, path)
        table.paths = [path] if fresh else [*table.paths, path]
        table.rows = self.spark.read.parquet(*table.paths).count()
        table.text_index = None

    def insert(self, name: str, values: list) -> bool:
        """One row, by position; False where the key is taken and the structure refuses that."""
        table = self._writable(name)
        row = [v if v is None else layout.to_value(c, v) for c, v in zip(table.columns, values, strict=True)]
        return self.append(name, self.spark.createDataFrame([tuple(row)], schema_of(table.columns))) == 1

    def append(self, name: str, rows: DataFrame) -> int:
        """Adds rows at once and returns how many came in.

        SEQ refuses keys that are there (of equal new keys the first comes in); Hash, RTree and BOW replace them (the
        last wins); BTree, ISAM and Heap keep both.
        """
        table = self._writable(name)
        new = with_positions(rows.select(*[F.col(f"`{c.name}`") for c in table.columns]), table.next_pos)
        key = table.key
        if table.structure in layout.UNIQUE:
            order = F.col(POSITION).asc() if table.structure == "SEQ" else F.col(POSITION).desc()
            new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
        if table.structure == "SEQ" and table.paths:
            new = new.join(self.stored(name).select(key), key, "left_anti")
        before = table.rows
        if table.structure in layout.UPSERT and table.paths:
            old = self.stored(name).join(new.select(key), key, "left_anti")
            merged = old.select(*new.columns).unionByName(new)
            kept = old.count()
            self._write(table, merged, True)
            added = table.rows - kept
        else:
            self._write(table, new, False)
            added = table.rows - before
        if added:
            table.next_pos = self.stored(name).agg(F.max(POSITION)).head()[0] + 1
        return added

    def delete(self, name: str, where: Expression) -> int:
        """Deletes the rows for which the condition is true and returns how many went."""
        table = self._writable(name)
        before = table.rows
        rows = self.stored(name)
        self._write(table, rows.where(~F.coalesce(where, F.lit(False))).select(*[c for c in rows.columns if c != layout.BUCKET]), True)
        return before - table.rows

    def update_at(self, name: str, pos: int, values: list) -> None:
        """Overwrites the row at a position."""
        table = self._writable(name)
        if not 0 <= pos < table.next_pos:
            raise ValueError(f"no position {pos}")
        rows = self.stored(name)
        here = F.col(POSITION) == pos
        new = [F.when(here, F.lit(layout.to_value(c, v)).cast(SPARK_TYPES[c.type]) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<double>")).otherwise(F.col(f"`{c.name}`")).alias(c.name) for c, v in zip(table.columns, values, strict=True)]
        self._write(table, rows.select(*new, POSITION), True)

    def clear(self, name: str) -> None:
        table = self._writable(name)
        table.paths, table.rows, table.next_pos, table.text_index = [], 0, 0, None

    def optimize(self, name: str) -> None:
        """Compacts base and deltas into one snapshot in the table's layout."""
        table = self._writable(name)
        if table.paths:
            rows = self.stored(name)
            self._write(table, rows.select(*[c for c in rows.columns if c != layout.BUCKET]), True)

    def _writable(self, name: str) -> Table:
        if self.tables[name].source is not None:
            raise ValueError(f"table '{name}' is read-only")
        return self.tables[name]

    # facts

    def info(self, name: str) -> dict:
        table = self.tables[name]
        return {
            "table_name": name, "structure": table.structure, "description": layout.DESCRIPTIONS[table.structure], "key": table.key, "record_count": self.count(name),
            "columns": [{"name": c.name, "type": c.type, "size": c.size, "is_key": c.is_key, "index": c.index} for c in table.columns],
        }
