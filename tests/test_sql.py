import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.sql.ast import Both, Compare
from sparkloom.sql.engine import Engine
from sparkloom.sql.parser import ParseError, parse, split_statements
from sparkloom.sql.translate import operation


def test_precedence_is_from_the_left():
    where = parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND c = 3;").where
    assert isinstance(where, Both) and where.operator == "AND" and where.left.operator == "OR"
    where = parse("SELECT * FROM t WHERE a = 1 OR (b = 2 AND c = 3);").where
    assert where.operator == "OR" and where.right.operator == "AND"


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t", "SELECT * FROM t WHERE a != 1;", "SELECT * FROM t WHERE a <> 1;", "SELECT * FROM t WHERE NOT a = 1;", "SELECT * FROM t WHERE a = NULL;", "DROP TABLE t;",
        "CREATE TABLE t (a INT PRIMARY KEY);", "CREATE TABLE t (a BOOLEAN KEY);", "CREATE TABLE t (key INT KEY);", "DELETE FROM t;", "UPDATE t SET a = 1;",
    ],
)
def test_refused(text):
    with pytest.raises(ParseError):
        parse(text)


@given(st.text(alphabet="ab ;-\\é", max_size=12), st.integers(-999, 999))
@settings(max_examples=50, deadline=None)
def test_literals_survive(text, number):
    found = parse(f"INSERT INTO t VALUES ('{text}', {number}, TRUE, [1.5, -2]);")
    assert found.values == [text, number, True, [1.5, -2.0]]
    assert len(split_statements(f"INSERT INTO t VALUES ('{text}'); SELECT * FROM t;")) == 2


@pytest.mark.parametrize(
    ("text", "line"),
    [
        ("SELECT * FROM t;", "scanAll(t)"), ("SELECT * FROM t WHERE c = 1;", "search(t, c, 1)"), ("SELECT * FROM t WHERE c BETWEEN 1 AND 2;", "rangeSearch(t, c, 1, 2)"),
        ("SELECT * FROM t WHERE c IN ([1, 2], 0.5);", "spatialRangeSearch(t, c, [1.0, 2.0], 0.5)"), ("SELECT * FROM t WHERE c IN (1, 2);", "scanAll(t)"), ("DELETE FROM t WHERE c = 1;", "remove(t, c, 1)"),
    ],
)
def test_access_path(text, line):
    assert operation(parse(text)) == line


def test_spatial_only_with_a_point():
    assert Compare("c", "IN", [[1.0, 2.0], 3]).spatial and not Compare("c", "IN", [1, 2]).spatial


def test_products_workflow(spark):
    e = Engine(spark)
    assert e.execute_sql("CREATE TABLE Productos (codigo INT KEY INDEX BTree, nombre VARCHAR[100], precio FLOAT, stock INT);").success
    out = e.execute_sql("INSERT INTO Productos VALUES (1, 'Laptop Dell', 1299.99, 10); INSERT INTO Productos VALUES (2, \"Mouse Logitech\", 25.50, 50); INSERT INTO Productos VALUES (3, 'Teclado Mecánico', 89.99, 30); SELECT * FROM Productos")
    assert out.success and out.queries_executed == 4 and len(out.collect()) == 3
    assert len(e.execute_sql("SELECT * FROM Productos WHERE codigo BETWEEN 1 AND 2;").collect()) == 2
    assert e.execute_sql("SELECT nombre FROM Productos WHERE precio < 50;").collect() == [{"nombre": "Mouse Logitech"}]
    assert e.execute_sql("DELETE FROM Productos WHERE codigo = 2;").success
    assert not e.execute_sql("DELETE FROM Productos WHERE codigo = 2;").success
    assert len(e.execute_sql("SELECT * FROM Productos;").collect()) == 2
    assert e.get_table_info("Productos")["record_count"] == 2 and e.list_tables() == ["Productos"] and len(e.get_query_history()) == 10


def test_structures_and_duplicates(spark):
    e = Engine(spark)
    for index, rows in (("SEQ", [(1, "a")]), ("BTree", [(1, "a"), (1, "b")]), ("ISAM", [(1, "a"), (1, "b")]), ("Hash", [(1, "b")])):
        e.execute_sql(f"CREATE TABLE t{index} (id INT KEY INDEX {index}, v VARCHAR[3]);")
        e.execute_sql(f"INSERT INTO t{index} VALUES (1, 'a');")
        second = e.execute_sql(f"INSERT INTO t{index} VALUES (1, 'bcdé');")
        assert second.success == (index != "SEQ")
        found = sorted((r["id"], r["v"][:1]) for r in e.execute_sql(f"SELECT * FROM t{index} WHERE id = 1;").collect())
        assert found == rows
    assert e.execute_sql("SELECT v FROM tHash;").collect() == [{"v": "bcd"}]  # cut at 3 bytes
    e.catalog.optimize("tISAM")
    assert e.catalog.count("tISAM") == 2
    assert e.catalog.read_at("tISAM", 0).head()["v"] == "a"
    with pytest.raises(ValueError):
        e.catalog.read_at("tISAM", 9)
    e.catalog.update_at("tISAM", 0, [5, "z"])
    assert e.catalog.read_at("tISAM", 0).head()["id"] == 5


def test_spatial_and_text_columns(spark):
    e = Engine(spark)
    e.execute_sql("CREATE TABLE r (id INT KEY, nombre VARCHAR[100], ubicacion ARRAY[FLOAT] INDEX RTree);")
    e.execute_sql("INSERT INTO r VALUES (1, 'La Bella Italia', [12.0462, -77.0428]);")
    assert len(e.execute_sql("SELECT * FROM r WHERE ubicacion IN ([12.05, -77.04], 0.01);").collect()) == 1
    assert len(e.execute_sql("SELECT * FROM r WHERE ubicacion IN ([12.05, -77.04], 0.001);").collect()) == 0
    e.execute_sql("CREATE TABLE d (id INT KEY, texto VARCHAR[500] INDEX BOW);")
    for i, t in enumerate(["el gato duerme mucho", "los perros corren", "un gato y un perro"], 1):
        e.execute_sql(f"INSERT INTO d VALUES ({i}, '{t}');")
    found = e.execute_sql("SELECT id FROM d WHERE texto = 'gatos durmiendo';").collect()
    assert [r["id"] for r in found] == [3, 1] or [r["id"] for r in found] == [1, 3]


def test_checks(spark):
    e = Engine(spark)
    e.execute_sql("CREATE TABLE u (name VARCHAR[5] KEY INDEX Hash, age INT);")
    for text in ("SELECT * FROM nope;", "SELECT x FROM u;", "SELECT * FROM U;", "SELECT * FROM u WHERE name BETWEEN 'a' AND 'b';", "INSERT INTO u VALUES (1);", "SELECT * FROM u WHERE age < 'x';", "CREATE TABLE v (a INT);", "CREATE TABLE v (a INT KEY, b INT KEY);", "CREATE TABLE v (a INT KEY INDEX RTree);", "SELECT * FROM u WHERE age IN ([1, 2], 3);"):
        out = e.execute_sql(text)
        assert not out.success and out.errors, text
        assert not e.validate_only(text)[0]
    assert not e.execute_sql("").success and not e.execute_sql("x" * 10_001).success


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("id,name,price\n1,a,1.5\n2,b,\n3,c,oops\n")
    e = Engine(spark)
    out = e.load_csv("x", str(p))
    assert out["inserted"] == 2 and out["errors"][0]["id"] == "3"
    assert e.execute_sql("SELECT price FROM x WHERE id = 2;").collect() == [{"price": 0.0}]
    assert e.preview("x", 1)["truncated"]


def test_rows_that_cannot_be_read_are_told(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,price\n1,2.5\nbad,3.5\n3,4.5\n")
    engine = Engine(spark)
    said = engine.execute_sql(f"CREATE TABLE x FROM FILE 'file://{tmp_path}/x.csv' USING INDEX ISAM('id');")
    assert said.success and "2 rows; 1 rows could not be read" in str(said.result)
    assert sorted(r["id"] for r in engine.execute_sql("SELECT id FROM x;").result.collect()) == [1, 3]
