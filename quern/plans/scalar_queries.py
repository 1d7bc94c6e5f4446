"""Scalar functions by family: each column's Spark expression beside DuckDB's.

Results of transcendental functions are rounded on both sides, as their last
digit is the platform's.
"""

from __future__ import annotations

import struct
import zlib

from ..sources.tables import table
from .catalog import ORACLE_SQL, QUERIES, query

#: name: (table, filter, key columns, [(column, Spark, DuckDB or None if the same)])
FAMILIES: dict[str, tuple[str, str, list[str], list[tuple[str, str, str | None]]]] = {
    "predicates": (
        "customer", "true", ["c_custkey"],
        [
            ("and_", "c_acctbal > 0 AND c_nationkey < 10", None),
            ("or_", "c_acctbal > 5000 OR c_nationkey = 3", None),
            ("not_", "NOT (c_nationkey = 3)", None),
            ("eq", "c_nationkey = 7", None),
            ("lt", "c_acctbal < 100", None),
            ("lte", "c_acctbal <= 100", None),
            ("gt", "c_acctbal > 100", None),
            ("gte", "c_acctbal >= 100", None),
            ("null_safe", "nullif(c_nationkey, 3) <=> nullif(c_nationkey, 4)", "nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(c_nationkey, 4)"),
            ("is_null", "nullif(c_nationkey, 3) IS NULL", None),
            ("is_not_null", "nullif(c_nationkey, 3) IS NOT NULL", None),
            ("in_", "c_nationkey IN (1, 5, 9)", None),
            ("in_set", "c_nationkey IN (0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22)", None),
            ("if_", "if(c_acctbal > 0, 'plus', 'minus')", "CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END"),
            ("case_", "CASE WHEN c_acctbal > 5000 THEN 'a' WHEN c_acctbal > 0 THEN 'b' END", None),
            ("coalesce_", "coalesce(nullif(c_nationkey, 3), -1)", None),
            ("nan_", "isnan(if(c_nationkey = 3, double('NaN'), c_acctbal))", "isnan(CASE WHEN c_nationkey = 3 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal END)"),
            ("nanvl_", "nanvl(if(c_nationkey = 3, double('NaN'), c_acctbal), 0D)", "CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END"),
            ("cast_int", "cast(c_acctbal AS INT)", "CAST(trunc(c_acctbal) AS INT)"),
            ("cast_text", "cast(c_custkey AS STRING)", "CAST(c_custkey AS VARCHAR)"),
            ("try_cast_", "try_cast(c_name AS INT)", "TRY_CAST(c_name AS INT)"),
            ("cast_bool", "cast(c_nationkey AS BOOLEAN)", "CAST(c_nationkey AS BOOLEAN)"),
            ("cast_decimal", "cast(cast(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE)", "CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE)"),
        ],
    ),
    "arithmetic": (
        "lineitem", "true", ["l_orderkey", "l_linenumber"],
        [
            ("add_", "l_quantity + l_tax", None),
            ("subtract_", "l_quantity - l_tax", None),
            ("multiply_", "l_quantity * l_discount", None),
            ("divide_", "l_extendedprice / l_quantity", None),
            ("try_divide_", "try_divide(l_extendedprice, l_linenumber - 1)", "CASE WHEN l_linenumber <> 1 THEN l_extendedprice / (l_linenumber - 1) END"),
            ("mod_", "l_orderkey % 7", None),
            ("pmod_", "pmod(2 - l_linenumber, 3)", "((2 - l_linenumber) % 3 + 3) % 3"),
            ("negate_", "-l_quantity", None),
            ("abs_", "abs(25 - l_quantity)", None),
            ("div_", "l_orderkey div 7", "l_orderkey // 7"),
            ("greatest_", "greatest(l_discount, l_tax, 0.05D)", "greatest(l_discount, l_tax, 0.05)"),
            ("least_", "least(l_discount, l_tax, 0.05D)", "least(l_discount, l_tax, 0.05)"),
            ("sign_", "signum(25 - l_quantity)", "CAST(sign(25 - l_quantity) AS DOUBLE)"),
            ("ceil_", "ceil(l_extendedprice)", "CAST(ceil(l_extendedprice) AS BIGINT)"),
            ("floor_", "floor(l_extendedprice)", "CAST(floor(l_extendedprice) AS BIGINT)"),
            ("round_", "round(l_linenumber / 2D)", "round(l_linenumber / 2.0)"),
            ("bround_", "bround(l_linenumber / 2D)", "round_even(l_linenumber / 2.0, 0)"),
            ("rint_", "rint(l_linenumber / 2D)", "round_even(l_linenumber / 2.0, 0)"),
            ("width_bucket_", "width_bucket(l_quantity, 0D, 50D, 5)", "CAST(CASE WHEN l_quantity >= 50 THEN 6 ELSE floor(l_quantity / 10) + 1 END AS BIGINT)"),
        ],
    ),
    "math": (
        "part", "true", ["p_partkey"],
        [
            *((f"{f}_", f"round({f}(p_size / 10D), 9)", f"round({f}(p_size / 10.0), 9)") for f in ("sin", "cos", "tan", "cot", "sinh", "cosh", "tanh", "asinh", "exp", "sqrt", "cbrt", "ln", "log2", "log10", "radians", "degrees", "atan")),
            ("acosh_", "round(acosh(1 + p_size / 10D), 9)", "round(acosh(1 + p_size / 10.0), 9)"),
            *((f"{f}_", f"round({f}(p_size / 100D), 9)", f"round({f}(p_size / 100.0), 9)") for f in ("asin", "acos", "atanh")),
            ("atan2_", "round(atan2(p_size, 3D), 9)", "round(atan2(p_size, 3.0), 9)"),
            ("hypot_", "round(hypot(p_size, 3D), 9)", "round(sqrt(p_size * p_size + 9.0), 9)"),
            ("power_", "round(power(p_size, 1.5D), 6)", "round(power(p_size, 1.5), 6)"),
            ("log1p_", "round(log1p(p_size), 9)", "round(ln(1.0 + p_size), 9)"),
            ("expm1_", "round(expm1(p_size / 10D), 6)", "round(exp(p_size / 10.0) - 1, 6)"),
            ("log_base", "round(log(3D, p_size + 1), 9)", "round(ln(p_size + 1.0) / ln(3.0), 9)"),
            ("sec_", "round(sec(p_size / 100D), 9)", "round(1 / cos(p_size / 100.0), 9)"),
            ("csc_", "round(csc(p_size / 100D), 9)", "round(1 / sin(p_size / 100.0), 9)"),
            ("e_", "round(e(), 12)", "round(exp(1.0), 12)"),
            ("pi_", "round(pi(), 12)", "round(pi(), 12)"),
            ("factorial_", "factorial(p_size % 15)", "CAST(factorial(p_size % 15) AS BIGINT)"),
            ("bin_", "bin(p_size)", "bin(p_size)"),
            ("hex_", "hex(p_size)", "hex(p_size)"),
            ("unhex_", "decode(unhex(hex(p_brand)), 'UTF-8')", "p_brand"),
            ("conv_", "conv(p_size, 10, 2)", "bin(p_size)"),
            ("bit_and_", "p_size & 12", None),
            ("bit_or_", "p_size | 12", None),
            ("bit_xor_", "p_size ^ 12", "xor(p_size, 12)"),
            ("bit_not_", "~p_size", None),
            ("shift_left", "shiftleft(p_size, 3)", "p_size << 3"),
            ("shift_right", "shiftright(p_size, 2)", "p_size >> 2"),
            ("shift_right_unsigned", "shiftrightunsigned(p_size, 1)", "p_size >> 1"),
        ],
    ),
    "strings": (
        "part", "true", ["p_partkey"],
        [
            ("like_", "p_name LIKE '%a%'", None),
            ("like_escape", "concat(p_name, '_x') LIKE '%\\\\_x' ESCAPE '\\\\'", "(p_name || '_x') LIKE '%\\_x' ESCAPE '\\'"),
            ("ilike_", "p_name ILIKE '%A%'", None),
            ("rlike_", "p_name RLIKE '[aeiou]{2}'", "regexp_matches(p_name, '[aeiou]{2}')"),
            ("regexp_replace_", "regexp_replace(p_name, '[aeiou]', '*')", "regexp_replace(p_name, '[aeiou]', '*', 'g')"),
            ("regexp_extract_", "regexp_extract(p_name, '([a-z]+)', 1)", "regexp_extract(p_name, '([a-z]+)', 1)"),
            ("regexp_extract_all_", "regexp_extract_all(p_name, '[aeiou]', 0)", "regexp_extract_all(p_name, '[aeiou]')"),
            ("ascii_", "ascii(p_name)", "ascii(p_name)"),
            ("chr_", "chr(65 + p_size % 26)", "chr(65 + p_size % 26)"),
            ("ends_with", "endswith(p_name, 'e')", "suffix(p_name, 'e')"),
            ("starts_with", "startswith(p_name, 'a')", "prefix(p_name, 'a')"),
            ("contains_", "contains(p_name, 'an')", "contains(p_name, 'an')"),
            ("concat_", "concat(p_brand, '-', p_type)", "p_brand || '-' || p_type"),
            ("concat_ws_", "concat_ws('/', p_brand, p_type)", "concat_ws('/', p_brand, p_type)"),
            ("instr_", "instr(p_name, 'a')", "instr(p_name, 'a')"),
            ("locate_", "locate('a', p_name, 3)", "CASE WHEN instr(substr(p_name, 3), 'a') > 0 THEN instr(substr(p_name, 3), 'a') + 2 ELSE 0 END"),
            ("length_", "length(p_name)", "length(p_name)"),
            ("lower_", "lower(p_brand)", None),
            ("upper_", "upper(p_name)", None),
            ("trim_", "trim(concat('  ', p_name, ' '))", "trim('  ' || p_name || ' ')"),
            ("ltrim_", "ltrim(concat('  ', p_name))", "ltrim('  ' || p_name)"),
            ("rtrim_", "rtrim(concat(p_name, '  '))", "rtrim(p_name || '  ')"),
            ("lpad_", "lpad(p_brand, 12, '*')", "lpad(p_brand, 12, '*')"),
            ("rpad_", "rpad(p_brand, 12, '*')", "rpad(p_brand, 12, '*')"),
            ("replace_", "replace(p_name, 'a', 'A')", None),
            ("reverse_", "reverse(p_name)", None),
            ("split_", "split(p_name, ' ')", "string_split(p_name, ' ')"),
            ("split_class", "split(p_name, '[aeiou]')", "string_split_regex(p_name, '[aeiou]')"),
            ("split_dot", "split(concat(p_brand, '.', p_type), '[.]')", "string_split(p_brand || '.' || p_type, '.')"),
            ("split_limit", "split(concat(p_brand, '.', p_type, '.z'), '[.]', 2)", "[p_brand, p_type || '.z']"),
            ("concat_one", "concat(p_brand)", "p_brand"),
            ("concat_none", "concat(concat(), p_brand)", "p_brand"),
            ("concat_null", "concat(p_brand, nullif(p_size, 7))", "CASE WHEN p_size <> 7 THEN p_brand || p_size END"),
            ("substring_", "substring(p_name, 2, 4)", None),
            ("substring_index_", "substring_index(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"),
            ("overlay_", "overlay(p_name PLACING 'XX' FROM 2 FOR 3)", "substr(p_name, 1, 1) || 'XX' || substr(p_name, 5)"),
            ("levenshtein_", "levenshtein(p_name, p_brand)", "levenshtein(p_name, p_brand)"),
            ("repeat_", "repeat(p_brand, 2)", None),
            ("translate_", "translate(p_name, 'aeiou', 'AEIOU')", None),
            ("space_", "concat('[', space(3), ']')", "'[' || repeat(' ', 3) || ']'"),
            ("base64_", "base64(cast(p_name AS BINARY))", "base64(encode(p_name))"),
            ("unbase64_", "decode(unbase64(base64(cast(p_name AS BINARY))), 'UTF-8')", "p_name"),
            ("initcap_", "initcap(lower(p_brand))", "upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2))"),
        ],
    ),
    "dates": (
        "orders", "true", ["o_orderkey"],
        [
            ("extract_", "extract(YEAR FROM o_orderdate)", "extract(year FROM o_orderdate)"),
            ("year_", "year(o_orderdate)", "year(o_orderdate)"),
            ("year_of_week", "extract(YEAROFWEEK FROM o_orderdate)", "isoyear(o_orderdate)"),
            ("quarter_", "quarter(o_orderdate)", "quarter(o_orderdate)"),
            ("month_", "month(o_orderdate)", "month(o_orderdate)"),
            ("week_", "weekofyear(o_orderdate)", "week(o_orderdate)"),
            ("weekday_", "weekday(o_orderdate)", "isodow(o_orderdate) - 1"),
            ("day_of_week", "dayofweek(o_orderdate)", "dayofweek(o_orderdate) + 1"),
            ("day_", "dayofmonth(o_orderdate)", "day(o_orderdate)"),
            ("day_of_year", "dayofyear(o_orderdate)", "dayofyear(o_orderdate)"),
            ("hour_", "hour(o_orderdate)", "hour(o_orderdate)"),
            ("minute_", "minute(o_orderdate)", "minute(o_orderdate)"),
            ("second_", "second(o_orderdate)", "second(o_orderdate)"),
            ("date_add_", "date_add(cast(o_orderdate AS DATE), 10)", "CAST(o_orderdate AS DATE) + 10"),
            ("date_sub_", "date_sub(cast(o_orderdate AS DATE), 10)", "CAST(o_orderdate AS DATE) - 10"),
            ("datediff_", "datediff(cast(o_orderdate AS DATE), date'1995-01-01')", "CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT)"),
            ("add_months_", "add_months(cast(o_orderdate AS DATE), 2)", "CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE)"),
            ("last_day_", "last_day(cast(o_orderdate AS DATE))", "last_day(o_orderdate)"),
            ("trunc_", "trunc(cast(o_orderdate AS DATE), 'MM')", "CAST(date_trunc('month', o_orderdate) AS DATE)"),
            ("date_format_", "date_format(o_orderdate, 'yyyy-MM')", "strftime(o_orderdate, '%Y-%m')"),
            ("unix_date_", "unix_date(cast(o_orderdate AS DATE))", "CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT)"),
            ("from_unix_date", "date_from_unix_date(unix_date(cast(o_orderdate AS DATE)))", "CAST(o_orderdate AS DATE)"),
            ("to_date_", "to_date(date_format(o_orderdate, 'yyyy-MM-dd'), 'yyyy-MM-dd')", "CAST(o_orderdate AS DATE)"),
            ("plus_interval", "o_orderdate + INTERVAL 3 HOURS", "o_orderdate + INTERVAL 3 HOUR"),
            ("minus_interval", "o_orderdate - INTERVAL 2 DAYS", "o_orderdate - INTERVAL 2 DAY"),
            ("plus_months", "o_orderdate + INTERVAL '1-2' YEAR TO MONTH", "o_orderdate + INTERVAL 14 MONTH"),
            ("from_unixtime_", "from_unixtime(o_orderkey * 3600)", "strftime(make_timestamp(o_orderkey * 3600000000), '%Y-%m-%d %H:%M:%S')"),
            ("unix_timestamp_", "unix_timestamp(to_timestamp('2020-01-02 03:04:05')) + o_orderkey", "1577934245 + o_orderkey"),
            ("to_unix_timestamp_", "to_unix_timestamp('1970-01-02', 'yyyy-MM-dd') + o_orderkey", "86400 + o_orderkey"),
            ("unix_millis_", "unix_millis(timestamp_micros(o_orderkey * 1000000))", "o_orderkey * 1000"),
            ("unix_micros_", "unix_micros(timestamp_micros(o_orderkey))", "o_orderkey"),
        ],
    ),
    "json_and_hashes": (
        "events", "true", ["event_id"],
        [
            ("get_json", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
            ("from_json_", "from_json(props, 'k STRING').k", "json_extract_string(props, '$.k')"),
            ("array_length", "json_array_length(concat('[', repeat('7,', cast(event_id % 5 AS INT)), event_id, ']'))", "CAST(event_id % 5 + 1 AS INT)"),
            ("to_json_", "to_json(named_struct('u', user_id, 't', event_type))", "'{\"u\":' || user_id || ',\"t\":\"' || event_type || '\"}'"),
            ("md5_", "md5(cast(event_type AS BINARY))", "md5(event_type)"),
            ("sha1_", "sha1(cast(event_type AS BINARY))", "sha1(event_type)"),
            ("sha2_", "sha2(event_type, 256)", "sha256(event_type)"),
        ],
    ),
    "casts": (
        "lineitem", "true", ["l_orderkey", "l_linenumber"],
        [
            ("long_to_int", "cast(l_orderkey AS INT)", None),
            ("int_to_long", "cast(l_linenumber AS BIGINT)", None),
            ("int_to_short", "cast(l_linenumber AS SMALLINT)", None),
            ("int_to_byte", "cast(l_linenumber AS TINYINT)", None),
            ("int_to_double", "cast(l_linenumber AS DOUBLE)", None),
            ("int_to_float", "cast(cast(l_linenumber AS FLOAT) AS DOUBLE)", None),
            ("int_to_text", "cast(l_linenumber AS STRING)", "CAST(l_linenumber AS VARCHAR)"),
            ("int_to_bool", "cast(l_linenumber - 1 AS BOOLEAN)", "CAST(l_linenumber - 1 AS BOOLEAN)"),
            ("int_to_decimal", "cast(cast(l_linenumber AS DECIMAL(10, 2)) AS STRING)", "CAST(CAST(l_linenumber AS DECIMAL(10, 2)) AS VARCHAR)"),
            ("double_to_long", "cast(l_extendedprice AS BIGINT)", "CAST(trunc(l_extendedprice) AS BIGINT)"),
            ("double_to_int", "cast(-l_extendedprice AS INT)", "CAST(trunc(-l_extendedprice) AS INT)"),
            ("double_to_short", "cast(l_quantity AS SMALLINT)", "CAST(trunc(l_quantity) AS SMALLINT)"),
            ("double_to_decimal", "cast(cast(l_extendedprice AS DECIMAL(14, 1)) AS STRING)", "CAST(CAST(l_extendedprice AS DECIMAL(14, 1)) AS VARCHAR)"),
            ("double_to_bool", "cast(l_discount AS BOOLEAN)", "l_discount <> 0"),
            ("text_to_int", "cast(concat(' ', l_linenumber, ' ') AS INT)", "l_linenumber"),
            ("text_to_long", "cast(cast(l_orderkey AS STRING) AS BIGINT)", "l_orderkey"),
            ("text_to_double", "cast(concat(l_linenumber, '.5e1') AS DOUBLE)", "l_linenumber * 10.0 + 5.0"),
            ("text_to_decimal", "cast(cast(concat('-', l_linenumber, '.25') AS DECIMAL(8, 2)) AS STRING)", "'-' || l_linenumber || '.25'"),
            ("text_to_bool", "cast(if(l_linenumber = 1, 'yes', 'f') AS BOOLEAN)", "l_linenumber = 1"),
            ("text_to_nothing", "try_cast(concat(l_returnflag, l_linenumber) AS INT)", "TRY_CAST(l_returnflag || l_linenumber AS INT)"),
            ("text_to_date", "cast(concat('2020-01-0', l_linenumber) AS DATE)", "CAST('2020-01-0' || l_linenumber AS DATE)"),
            ("text_to_timestamp", "cast(concat('2020-01-0', l_linenumber, ' 10:11:12') AS TIMESTAMP_NTZ)", "CAST('2020-01-0' || l_linenumber || ' 10:11:12' AS TIMESTAMP)"),
            ("text_to_binary", "hex(cast(l_returnflag AS BINARY))", "hex(l_returnflag)"),
            ("date_to_text", "cast(cast(l_shipdate AS DATE) AS STRING)", "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"),
            ("date_to_timestamp", "cast(cast(l_shipdate AS DATE) AS TIMESTAMP_NTZ)", "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)"),
            ("timestamp_to_date", "cast(cast(l_shipdate AS TIMESTAMP_NTZ) AS DATE)", "CAST(l_shipdate AS DATE)"),
            ("bool_to_int", "cast(l_linenumber = 1 AS INT)", "CAST(l_linenumber = 1 AS INT)"),
            ("bool_to_text", "cast(l_linenumber = 1 AS STRING)", "CAST(l_linenumber = 1 AS VARCHAR)"),
            ("bool_to_double", "cast(l_linenumber = 1 AS DOUBLE)", "CAST(CAST(l_linenumber = 1 AS INT) AS DOUBLE)"),
            ("decimal_to_decimal", "cast(cast(cast(l_extendedprice AS DECIMAL(14, 2)) AS DECIMAL(16, 4)) AS STRING)", "CAST(CAST(CAST(l_extendedprice AS DECIMAL(14, 2)) AS DECIMAL(16, 4)) AS VARCHAR)"),
            ("decimal_to_long", "cast(cast(l_quantity AS DECIMAL(8, 0)) AS BIGINT)", "CAST(CAST(l_quantity AS DECIMAL(8, 0)) AS BIGINT)"),
            ("array_cast", "cast(array(l_linenumber, 2) AS ARRAY<STRING>)", "[CAST(l_linenumber AS VARCHAR), '2']"),
            ("null_cast", "cast(nullif(l_linenumber, 1) AS STRING)", "CAST(nullif(l_linenumber, 1) AS VARCHAR)"),
        ],
    ),
    "arrays": (
        "embeddings", "true", ["vec_id"],
        [
            ("size_", "size(embedding)", "len(embedding)"),
            ("get_item", "get(embedding, 0)", "embedding[1]"),
            ("element_at_", "element_at(embedding, 2)", "embedding[2]"),
            ("try_element_at_", "try_element_at(embedding, 100000)", "NULL"),
            ("array_", "array(label, label + 1)", "[label, label + 1]"),
            ("contains_", "array_contains(array(1, 2, 3), label)", "list_contains([1, 2, 3], label)"),
            ("max_", "array_max(embedding)", "list_max(embedding)"),
            ("min_", "array_min(embedding)", "list_min(embedding)"),
            ("sequence_", "sequence(label, label + 3)", "range(label, label + 4)"),
            ("sort_asc", "slice(sort_array(embedding), 1, 3)", "list_sort(embedding)[1:3]"),
            ("sort_desc", "slice(sort_array(embedding, false), 1, 3)", "list_reverse_sort(embedding)[1:3]"),
            ("array_sort_", "array_sort(array(3, label, 1))", "list_sort([3, label, 1])"),
            ("overlap", "arrays_overlap(array(1, 2), array(label, 9))", "list_has_any([1, 2], [label, 9])"),
            ("slice_", "slice(embedding, 2, 3)", "embedding[2:4]"),
            ("join_", "array_join(array('a', cast(label AS STRING)), '-')", "'a-' || label"),
            ("repeat_", "array_repeat(label, 2)", "[label, label]"),
            ("distinct_", "array_sort(array_distinct(array(label, 1, 1)))", "list_sort(list_distinct([label, 1, 1]))"),
            ("position_", "array_position(array(0, 1, 2, 3), label)", "coalesce(list_position([0, 1, 2, 3], label), 0)"),
            ("intersect_", "array_sort(array_intersect(array(label, 1, 2), array(1, 2, 3)))", "list_sort(list_intersect([label, 1, 2], [1, 2, 3]))"),
            ("union_", "array_sort(array_union(array(label, 1), array(1, 2)))", "list_sort(list_distinct([label, 1, 1, 2]))"),
            ("except_", "array_sort(array_except(array(label, 1, 7), array(1)))", "list_sort(list_filter(list_distinct([label, 1, 7]), lambda x: x <> 1))"),
            ("remove_", "array_remove(array(label, 1, 1), 1)", "list_filter([label, 1, 1], lambda x: x <> 1)"),
            ("flatten_", "flatten(array(array(label), array(1, 2)))", "[label, 1, 2]"),
            ("reverse_", "reverse(array(label, 1, 2))", "[2, 1, label]"),
            ("concat_", "concat(array(label), array(5))", "[label, 5]"),
            ("zip_", "arrays_zip(array(label, 2), array(3, label + 4))[1]['1']", "label + 4"),
            ("map_value", "map('a', label, 'b', 2)['a']", "label"),
            ("map_keys_", "array_sort(map_keys(map('a', label, 'b', 2)))", "['a', 'b']"),
            ("map_values_", "array_sort(map_values(map('a', label, 'b', 2)))", "list_sort([label, 2])"),
            ("map_from_arrays_", "map_from_arrays(array('x', 'y'), array(1, label + 5))['y']", "label + 5"),
            ("struct_field", "named_struct('p', label, 'q', 1).p", "label"),
            ("structs_field", "array(named_struct('p', label), named_struct('p', 4)).p", "[label, 4]"),
        ],
    ),
}


def _query(name: str):
    source, condition, keys, columns = FAMILIES[name]

    def run(spark, d):
        return table(spark, d, source).filter(condition).selectExpr(*keys, *(f"{spark_sql} AS {c}" for c, spark_sql, _ in columns))

    return run


for _name, (_source, _condition, _keys, _columns) in FAMILIES.items():
    QUERIES[f"functions_{_name}"] = _query(_name)
    ORACLE_SQL[f"functions_{_name}"] = f"SELECT {', '.join(_keys)}, " + ", ".join(f"{duck or spark_sql} AS {c}" for c, spark_sql, duck in _columns) + f" FROM {_source} WHERE {_condition}"


def murmur3(data: bytes, seed: int = 42) -> int:
    """32-bit Murmur3 as Spark's hash() takes it of text: the bytes after the last whole word are mixed one by one, as signed words of their own. Written for the expected values below."""
    mask = 0xFFFFFFFF
    turned = lambda x, n: (x << n | x >> (32 - n)) & mask
    whole = len(data) // 4 * 4
    h = seed
    for k in [*struct.unpack(f"<{whole // 4}i", data[:whole]), *struct.unpack(f"{len(data) - whole}b", data[whole:])]:
        h = turned(h ^ turned(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


#: The flags that lineitem knows, with a longer text beside each. XXH64 of them (seed 42) has no function in SQL; fixed values.
_FLAGGED = {"A": "A flag", "N": "N flag", "R": "R flag"}
_XXH64 = {"A flag": 2802974720799278231, "N flag": -1214345457581232149, "R flag": -1736975519920269677}


@query("SELECT l_orderkey, l_linenumber, crc, murmur, xx FROM lineitem JOIN (VALUES " + ", ".join(f"('{f}', CAST({zlib.crc32(t.encode())} AS BIGINT), CAST({murmur3(t.encode())} AS INT), CAST({_XXH64[t]} AS BIGINT))" for f, t in _FLAGGED.items()) + ") AS v(flag, crc, murmur, xx) ON l_returnflag = flag")
def functions_checksums(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat(l_returnflag, ' flag') AS t").selectExpr("l_orderkey", "l_linenumber", "crc32(t) AS crc", "hash(t) AS murmur", "xxhash64(t) AS xx")
