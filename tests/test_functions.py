from decimal import Decimal

from pyspark.sql import functions as F

from fleetlens.functions import exact_ratio, int_div, statement_slice


def test_exact_ratio_rounds_half_away_from_zero_without_double_rounding(spark):
    df = spark.createDataFrame([(1005000, 1000000), (-1005000, 1000000), (1, 3), (2, 3), (0, 5), (7, 0),
                                (10049996, 10000000)], "n long, d long")
    out = [r[0] for r in df.select(exact_ratio("n", "d")).collect()]
    assert out == [Decimal("1.01"), Decimal("-1.01"), Decimal("0.33"), Decimal("0.67"), Decimal("0.00"), None,
                   Decimal("1.00")]


def test_exact_ratio_scale_above_six(spark):
    df = spark.createDataFrame([(1,)], "p long")
    assert df.select(exact_ratio("p", F.lit(128), scale=7, precision=38)).first()[0] == Decimal("0.0078125")


def test_int_div_truncates_toward_zero(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (5, 0)], "a long, b long")
    assert [r[0] for r in df.select(int_div("a", "b")).collect()] == [3, -3, -3, None]


def test_statement_slice_edges(spark):
    rows = [("abcdefghij", 0, -1), ("abcdefghij", 4, 9), ("abcdefghij", 4, None), ("abc  ", 0, -1),
            ("ab", 18, -1), ("a😀bcd", 2, 5), ("abcdefghij", 3, 6), ("abcdefghij", None, 6)]
    df = spark.createDataFrame(rows, "t string, s int, e int")
    out = [r[0] for r in df.select(statement_slice("t", "s", "e")).collect()]
    # end -1 / NULL: to the end (LEN ignores trailing blanks); negative length: ''
    assert out == ["abcdefghij", "cde", "cdefghij", "abc ", "", "😀", "bc", None]   # two units, one character


def test_rounded_key_matches_the_exact_decimal(spark):
    import random
    from fleetlens.functions.numeric import rounded_key
    rnd = random.Random(5)
    vals = [rnd.randint(-10**12, 10**12) for _ in range(300)] + [1005000, 1004999, -1005000, 0, 5000, 4999]
    df = spark.createDataFrame([(v,) for v in vals], "n long")
    rows = df.select(rounded_key("n", 1000000).alias("k"), exact_ratio("n", F.lit(1000000)).alias("d")).collect()
    assert all(Decimal(r.k) / 100 == r.d for r in rows)


def _tsql_slice(text, start, end):
    """The server's formula, written out in Python over UTF-16 units."""
    if text is None or start is None:
        return None
    units = text.encode("utf-16-le")
    stop = len(text.rstrip(" ").encode("utf-16-le")) if end is None or end == -1 else end
    diff = stop - start
    length = max(int(diff / 2) + 1, 0)            # int() truncates toward zero like T-SQL
    pos = start // 2 + 1
    return units[2 * (pos - 1):2 * (pos - 1 + length)].decode("utf-16-le", errors="replace")


def test_statement_slice_matches_the_formula_on_random_input(spark):
    import random
    rnd = random.Random(17)
    alphabet = "ab cé😀"
    rows = []
    for _ in range(300):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
        s = rnd.randint(0, 70)
        e = rnd.choice([-1, None, rnd.randint(0, 80)])
        rows.append((t, s, e))
    df = spark.createDataFrame(rows, "t string, s int, e int")
    got = [r[0] for r in df.select(statement_slice("t", "s", "e")).collect()]
    assert got == [_tsql_slice(*r) for r in rows]


def test_exact_ratio_matches_python_decimal(spark):
    import random
    from decimal import ROUND_HALF_UP
    rnd = random.Random(23)
    rows = [(rnd.randint(-10**9, 10**9), rnd.choice([1, 3, 7, 1000, 1000000, rnd.randint(1, 10**6)]) * rnd.choice([1, -1]))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "n long, d long")
    got = [r[0] for r in df.select(exact_ratio("n", "d", scale=3, factor=100)).collect()]
    exp = [(Decimal(n) * 100 / Decimal(d)).quantize(Decimal("0.001"), rounding=ROUND_HALF_UP) for n, d in rows]
    assert got == exp


def test_safe_ratio_quote_name_rewrite_and_render(spark):
    from fleetlens.functions import quote_name, render_statement, rewrite_text, safe_ratio
    df = spark.createDataFrame([(6, 3, "a]b", "CREATE VIEW [RPS2017].v"), (1, 0, None, "x")],
                               "n long, d long, name string, src string")
    r = df.select(safe_ratio("n", "d").alias("q"), safe_ratio("n", "d", default=0).alias("q0"),
                  quote_name("name").alias("qn"),
                  rewrite_text("src", [("[RPS2017].", ""), ("CREATE VIEW", "ALTER VIEW")]).alias("rw"),
                  render_statement("X ", F.col("name"), ";").alias("st"),
                  render_statement("X ", F.col("name"), ";", skip_null=True).alias("st2")).collect()
    assert (r[0].q, r[0].q0, r[0].qn, r[0].rw, r[0].st) == (2.0, 2.0, "[a]]b]", "ALTER VIEW v", "X a]b;")
    assert (r[1].q, r[1].q0, r[1].qn, r[1].st, r[1].st2) == (None, 0, None, None, "X ;")


def test_multi_filter_and_distinct_string_agg(spark):
    from fleetlens.operators import distinct_string_agg, multi_filter
    df = spark.createDataFrame([("srv1", "Sales"), ("srv1", "sales"), ("srv2", "Orders"), ("srv1", "Bills")],
                               "server string, t string")
    assert {r.t for r in multi_filter(df, {"server": "SRV1", "t": "LES"}).collect()} == {"Sales", "sales"}
    assert multi_filter(df, {"server": None}).count() == 4
    got = {r.server: r.t_list for r in distinct_string_agg(df, ["server"], "t").collect()}
    assert got == {"srv1": "Bills, Sales, sales", "srv2": "Orders"}


def test_safe_ratio_of_whole_numbers(spark):
    from fleetlens.functions import safe_ratio
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, 0), (None, 2), (7, None), (None, 0)], "n long, d long")
    rows = df.select(safe_ratio("n", "d", whole=True).alias("q"), safe_ratio("n", "d", 0, whole=True).alias("q0"))
    assert [tuple(r) for r in rows.collect()] == [(3, 3), (-3, -3), (None, 0), (None, None), (None, None), (None, 0)]
    assert {f.dataType.typeName() for f in rows.schema} == {"long"}


def test_parallel_operator_as_one_xml_value(spark):
    from pyspark.sql import functions as F
    from fleetlens.plans.plancache import has_parallel_operator, parallel_flag
    flags = {"1": True, "0": False, "true": True, "True": True, "TRUE": True, "false": False, " 1 ": True, "0.5": True, "-1": False, "": False, "x": False}
    df = spark.createDataFrame([(f, f'<P Parallel="1"><RelOp Parallel="0"><RelOp Parallel="{f}"/></RelOp></P>') for f in flags]
                               + [("none", '<P Parallel="1"><RelOp/></P>'), ("null", None)], "f string, d string")
    got = {r.f: (r.p, r.n) for r in df.select("f", has_parallel_operator(F.col("d")).alias("p"), parallel_flag(F.col("d")).alias("n")).collect()}
    assert {f: got[f][0] for f in flags} == flags and got["none"] == (False, None) and got["null"] == (False, None)
    assert all(bool(got[f][1]) == flags[f] for f in flags)


def test_xml_scalar_reads_one_value(spark):
    from fleetlens.functions import xml_scalar
    df = spark.createDataFrame([('<a n="3"><b>x</b></a>',), ("<a/>",)], "d string")
    rows = df.select(xml_scalar("d", "/a/b").alias("s"), xml_scalar("d", "/a/@n", "int").alias("n"),
                     xml_scalar("d", "/a/b", "boolean").alias("e")).collect()
    assert [(r.s, r.n, r.e) for r in rows] == [("x", 3, True), ("", 0, False)]
