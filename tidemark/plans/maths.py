"""Math, bitwise and conditional functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import random
from tidemark.functions.projection import project
from tidemark.operators import blocks
from tidemark.registry import query

X = "(c_custkey % 200 - 100) / 100"  # in [-1, 1)


def x():
    return F.expr(X)


def rounded(name, table, sql, column, digits=9):
    project(name, table, f"round({sql}, {digits})", lambda: F.round(column(), digits))


project("mf01_abs", "customer", "abs(c_acctbal)", lambda: F.abs("c_acctbal"))
rounded("mf02_acos", "customer", f"acos({X})", lambda: F.acos(x()))
rounded("mf03_asin", "customer", f"asin({X})", lambda: F.asin(x()))
rounded("mf04_atan", "customer", "atan(c_acctbal)", lambda: F.atan("c_acctbal"))
project("mf05_bin", "customer", "bin(c_custkey)", lambda: F.bin("c_custkey"))
project("mf06_ceil", "customer", "CAST(ceil(c_acctbal) AS BIGINT)", lambda: F.ceil("c_acctbal"))
project("mf07_conv", "customer", "hex(c_custkey)", lambda: F.conv(F.col("c_custkey").cast("string"), 10, 16))
rounded("mf08_cos", "customer", "cos(c_acctbal)", lambda: F.cos("c_acctbal"))
rounded("mf09_degrees", "customer", f"degrees({X})", lambda: F.degrees(x()))
rounded("mf10_exp", "customer", f"exp({X})", lambda: F.exp(x()))
project("mf11_floor", "customer", "CAST(floor(c_acctbal) AS BIGINT)", lambda: F.floor("c_acctbal"))
project("mf12_hex", "customer", "hex(c_custkey)", lambda: F.hex("c_custkey"))
rounded("mf13_ln", "customer", "CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END", lambda: F.ln("c_acctbal"))
rounded("mf14_log_base", "part", "ln(p_retailprice) / ln(3)", lambda: F.log(3.0, F.col("p_retailprice")))
rounded("mf15_log10", "part", "log10(p_retailprice)", lambda: F.log10("p_retailprice"))
rounded("mf16_log2", "part", "log2(p_retailprice)", lambda: F.log2("p_retailprice"))
project("mf17_negative", "customer", "-c_acctbal", lambda: F.negative("c_acctbal"))
project("mf18_pmod", "customer", "((c_custkey - 500) % 7 + 7) % 7", lambda: F.pmod(F.col("c_custkey") - 500, F.lit(7)))
project("mf19_positive", "customer", "+c_acctbal", lambda: F.positive("c_acctbal"))
rounded("mf20_power", "part", "p_size ** 1.5", lambda: F.pow("p_size", F.lit(1.5)))
rounded("mf21_radians", "customer", "radians(c_acctbal)", lambda: F.radians("c_acctbal"))
project("mf22_round", "customer", "round(c_acctbal * 4, 1)", lambda: F.round(F.col("c_acctbal") * 4, 1))
project("mf23_sign", "customer", "CAST(sign(c_acctbal - 3000) AS DOUBLE)", lambda: F.signum(F.col("c_acctbal") - 3000))
rounded("mf24_sin", "customer", "sin(c_acctbal)", lambda: F.sin("c_acctbal"))
rounded("mf25_sqrt", "part", "sqrt(p_retailprice)", lambda: F.sqrt("p_retailprice"))
rounded("mf26_tan", "customer", f"tan({X})", lambda: F.tan(x()))
project("mf27_unhex", "customer", "decode(unhex(hex(c_name)))", lambda: F.decode(F.unhex(F.hex("c_name")), "UTF-8"))
project(
    "mf28_greatest", "customer", "greatest(nullif(c_nationkey % 3, 0), c_nationkey % 5, 1)",
    lambda: F.greatest(F.expr("nullif(c_nationkey % 3, 0)"), F.col("c_nationkey") % 5, F.lit(1)),
)


@query("ma30_arithmetic", """
    SELECT c_custkey, c_custkey + c_nationkey AS plus, c_custkey - c_nationkey AS minus, c_custkey * c_nationkey AS times,
           round(c_custkey / nullif(c_nationkey, 0), 9) AS ratio, c_custkey % nullif(c_nationkey, 0) AS modulo, c_custkey // nullif(c_nationkey, 0) AS div FROM customer""")
def _(t):
    # division by zero gives NULL, whatever the session's ANSI setting
    a, b = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.select(
        "c_custkey", (a + b).alias("plus"), (a - b).alias("minus"), (a * b).alias("times"),
        F.round(F.try_divide(a, b), 9).alias("ratio"), F.try_mod(a, b).alias("modulo"),
        F.expr("c_custkey div nullif(c_nationkey, 0)").alias("div"))


rounded("ma31_pi", "customer", "c_acctbal * pi()", lambda: F.col("c_acctbal") * F.pi(), 6)
rounded("ma43_e", "customer", "c_acctbal * exp(1)", lambda: F.col("c_acctbal") * F.e(), 6)
project("ma32_bitwise_and", "customer", "c_custkey & 85", lambda: F.col("c_custkey").bitwiseAND(F.lit(85)))
project("ma33_bitwise_or", "customer", "c_custkey | 85", lambda: F.col("c_custkey").bitwiseOR(F.lit(85)))
project("ma34_bitwise_xor", "customer", "xor(c_custkey, 85)", lambda: F.col("c_custkey").bitwiseXOR(F.lit(85)))
project("ma35_bitwise_not", "customer", "~c_custkey", lambda: F.bitwise_not("c_custkey"))
project("ma36_rand", "customer", None, lambda: F.rand(seed=17))
project("ma37_randn", "customer", None, lambda: F.randn(seed=17))


@query("ma38_random_columns")
def _(t):
    k = "c_custkey"
    return t.customer.select(
        k, random.uniform(1, k).alias("uniform"), random.normal(2, k).alias("normal"),
        random.poisson(2.0, 3, k).alias("poisson"), random.exponential(3.0, 4, k).alias("exponential"),
        random.gamma(2, 1.5, 5, k).alias("gamma"), random.log_normal(0.0, 0.5, 9, k).alias("log_normal"))


@query("ma39_decimal", """
    SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(10, 2)) * CAST(1.05 AS DECIMAL(3, 2)) AS DOUBLE) AS product,
           CAST(TRY_CAST(CAST(c_acctbal AS DECIMAL(10, 2)) AS DECIMAL(5, 2)) AS DOUBLE) AS overflow_is_null,
           CAST(CAST(c_acctbal AS DECIMAL(10, 2)) + CAST(c_custkey AS DECIMAL(10, 0)) AS VARCHAR) AS total FROM customer""")
def _(t):
    money = F.col("c_acctbal").cast("decimal(10,2)")
    return t.customer.select(
        "c_custkey", (money * F.lit("1.05").cast("decimal(3,2)")).cast("double").alias("product"),
        money.try_cast("decimal(5,2)").cast("double").alias("overflow_is_null"),
        (money + F.col("c_custkey").cast("decimal(10,0)")).cast("string").alias("total"))


@query("ma40_conditional", """
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS if_, CASE c_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS case_,
           coalesce(nullif(c_nationkey % 4, 0), 9) AS coalesce_, coalesce(nullif(c_nationkey % 4, 0), 8) AS nvl_,
           CASE WHEN nullif(c_nationkey % 4, 0) IS NOT NULL THEN 'x' ELSE 'y' END AS nvl2_, nullif(c_nationkey, 3) AS nullif_,
           coalesce(nullif(c_nationkey, 3), 0) AS ifnull_ FROM customer""")
def _(t):
    n4 = F.expr("nullif(c_nationkey % 4, 0)")
    n = F.col("c_nationkey")
    return t.customer.select(
        "c_custkey", F.expr("if(c_acctbal > 0, 'pos', 'neg')").alias("if_"), F.when(n % 3 == 0, "a").when(n % 3 == 1, "b").alias("case_"),
        F.coalesce(n4, F.lit(9)).alias("coalesce_"), F.nvl(n4, F.lit(8)).alias("nvl_"), F.nvl2(n4, F.lit("x"), F.lit("y")).alias("nvl2_"),
        F.nullif(n, F.lit(3)).alias("nullif_"), F.ifnull(F.nullif(n, F.lit(3)), F.lit(0)).alias("ifnull_"))


@query("ma41_nan", """
    WITH x AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS d FROM customer)
    SELECT c_custkey, isnan(d) AS is_nan, CASE WHEN isnan(d) THEN -1.0 ELSE d END::DOUBLE AS replaced, d > 1e300 AS larger, d = d AS equal,
           CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY d) AS INTEGER) AS place FROM x""")
def _(t):
    """NaN equals NaN and comes last; a nation may hold any share of the customers."""
    d = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    rows = t.customer.select("c_custkey", "c_nationkey", d.alias("d"))
    return blocks.rank(blocks.numbered(rows, ["c_nationkey"], ["d", "c_custkey"]), ["c_nationkey"], ["d"], name="place").select(
        "c_custkey", F.isnan("d").alias("is_nan"), F.nanvl("d", F.lit(-1.0)).alias("replaced"), (F.col("d") > 1e300).alias("larger"),
        (F.col("d") == F.col("d")).alias("equal"), F.col("place").cast("int"))
