"""String and regular-expression functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.projection import project

project("sf01_ascii", "part", "ascii(p_name)", lambda: F.ascii("p_name"))
project("sf02_concat", "customer", "c_name || '/' || nullif(c_mktsegment, 'BUILDING')", lambda: F.concat("c_name", F.lit("/"), F.expr("nullif(c_mktsegment, 'BUILDING')")))
project("sf03_concat_ws", "customer", "concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), 'z')", lambda: F.concat_ws("-", "c_name", F.expr("nullif(c_mktsegment, 'BUILDING')"), F.lit("z")))
project("sf04_elt", "part", "['a', p_type, p_brand][p_size % 3 + 1]", lambda: F.elt(F.col("p_size") % 3 + 1, F.lit("a"), F.col("p_type"), F.col("p_brand")))
project("sf05_find_in_set", "part", "coalesce(list_position(['SMALL', 'ECONOMY', 'LARGE'], p_type), 0)::INTEGER", lambda: F.find_in_set("p_type", F.lit("SMALL,ECONOMY,LARGE")))
project("sf06_format_number", "orders", "format('{:,.2f}', o_totalprice)", lambda: F.format_number("o_totalprice", 2))
project("sf07_instr", "part", "instr(p_name, 'o')::INTEGER", lambda: F.instr("p_name", "o"))
project("sf08_length", "documents", "length(text)::INTEGER", lambda: F.length("text"))
project("sf09_locate", "part", "CASE WHEN instr(substring(p_name, 4), 'e') = 0 THEN 0 ELSE instr(substring(p_name, 4), 'e') + 3 END::INTEGER", lambda: F.locate("e", F.col("p_name"), 4))
project("sf10_lower", "documents", "lower(text)", lambda: F.lower("text"))
project("sf11_lpad", "customer", "lpad(CAST(c_custkey AS VARCHAR), 6, '0*')", lambda: F.lpad(F.col("c_custkey").cast("string"), 6, "0*"))
project("sf12_ltrim", "part", "ltrim('  ' || p_name || ' ')", lambda: F.ltrim(F.concat(F.lit("  "), "p_name", F.lit(" "))))
project("sf13_parse_url", "pages", "nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '')", lambda: F.try_parse_url("url", F.lit("HOST")))
project("sf14_printf", "orders", "printf('%06d|%s|%.2f', o_orderkey, o_orderstatus, o_totalprice)", lambda: F.printf(F.lit("%06d|%s|%.2f"), "o_orderkey", "o_orderstatus", "o_totalprice"))
project("sf15_regexp_extract", "pages", "regexp_extract(url, '([a-z]+)://([a-z.]+)', 2)", lambda: F.regexp_extract("url", "([a-z]+)://([a-z.]+)", 2))
project("sf16_regexp_replace", "documents", "regexp_replace(text, '[aeiou]+', '<\\0>', 'g')", lambda: F.regexp_replace("text", "([aeiou]+)", "<$1>"))
project("sf17_repeat", "part", "repeat(p_type, p_size % 4)", lambda: F.repeat("p_type", F.col("p_size") % 4))
project("sf18_reverse", "part", "reverse(p_name)", lambda: F.reverse("p_name"))
project("sf19_rpad", "part", "rpad(p_name, 8, '.')", lambda: F.rpad("p_name", 8, "."))
project("sf20_rtrim", "part", "rtrim(' ' || p_name || '   ')", lambda: F.rtrim(F.concat(F.lit(" "), "p_name", F.lit("   "))))
project("sf21_sentences", "documents", None, lambda: F.transform(F.sentences("text"), lambda s: F.array_join(s, " ")))
project("sf22_space", "part", "repeat(' ', p_size)", lambda: F.expr("space(p_size)"))
project("sf23_split", "part", "string_split(p_name, ' ')", lambda: F.split("p_name", " "))
project("sf24_str_to_map", "customer", "c_mktsegment || '=' || c_nationkey", lambda: F.expr("concat(str_to_map(concat('a:', c_nationkey, ',s:', c_mktsegment), ',', ':')['s'], '=', str_to_map(concat('a:', c_nationkey, ',s:', c_mktsegment), ',', ':')['a'])"))
project("sf25_substr", "customer", "substring(c_name, 3, 4) || '|' || c_name[-4:]", lambda: F.concat(F.substring("c_name", 3, 4), F.lit("|"), F.substring("c_name", -4, 4)))
project("sf26_translate", "part", "translate(p_name, 'aeiou', 'AEI')", lambda: F.translate("p_name", "aeiou", "AEI"))
project("sf27_trim", "part", "trim('  ' || p_name || '  ')", lambda: F.trim(F.concat(F.lit("  "), "p_name", F.lit("  "))))
project("sf28_upper", "part", "upper(p_name)", lambda: F.upper("p_name"))
project("sf40_column_methods", "customer", "substring(c_name, 2, 5) || CAST(starts_with(c_name, 'Cust') AS VARCHAR) || CAST(ends_with(c_name, '7') AS VARCHAR)",
        lambda: F.concat(F.col("c_name").substr(2, 5), F.col("c_name").startswith("Cust").cast("string"), F.col("c_name").endswith("7").cast("string")))
project("sf41_binary", "customer", "hex(c_name) || decode('\\x41\\x42'::BLOB)", lambda: F.concat(F.hex(F.encode("c_name", "UTF-8")), F.decode(F.expr("x'4142'"), "UTF-8")))
project("sf42_format_string", "part", "printf('%s (%d) %.1f%%', p_name, p_size, p_retailprice)", lambda: F.format_string("%s (%d) %.1f%%", "p_name", "p_size", "p_retailprice"))
project("sf43_like_escape", "documents", "source LIKE 'src_' AND NOT ('a_b' || source LIKE 'a#_bsrc1_' ESCAPE '#')", lambda: F.expr("source LIKE 'src_' AND NOT (concat('a_b', source) LIKE 'a#_bsrc1_' ESCAPE '#')"))
project("sf44_lcase_ucase", "part", "lower(p_type) || upper(p_name)", lambda: F.concat(F.lcase("p_type"), F.ucase("p_name")))
project("sf45_substring", "part", "substring(p_name, 2, 3)", lambda: F.substring("p_name", 2, 3))
