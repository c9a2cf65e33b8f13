"""A call of each function name with the text of its value, worked out by hand: (name, arguments as SQL, value)."""

from __future__ import annotations

_T = "TIMESTAMP '2024-03-15 13:45:50'"
_D = "DATE '2024-03-15'"
_J = """'{"a": {"b": [1, 2]}, "c": "x", "n": null}'"""

EXAMPLES: dict[str, list[tuple[str, list[str], str | None]]] = {
    "text": [
        ("ascii", ["'A'"], "65"), ("bit_length", ["'ab'"], "16"), ("byte_length", ["'é'"], "2"), ("length", ["'é'"], "1"), ("concat", ["'a'", "'b'"], "ab"), ("concat_ws", ["'-'", "'a'", "'b'"], "a-b"), ("contains", ["'abc'", "'b'"], "true"),
        ("ends_with", ["'abc'", "'bc'"], "true"), ("starts_with", ["'abc'", "'ab'"], "true"), ("initcap", ["'ab cd'"], "Ab Cd"), ("lower", ["'AB'"], "ab"), ("upper", ["'ab'"], "AB"), ("left", ["'abc'", "2"], "ab"), ("right", ["'abc'", "2"], "bc"),
        ("pad", ["'a'", "3", "'x'"], "xxa"), ("repeat", ["'ab'", "2"], "abab"), ("replace", ["'aba'", "'a'", "'c'"], "cbc"), ("reverse", ["'abc'"], "cba"), ("rtrimmed_length", ["'ab  '"], "2"), ("soundex", ["'Robert'"], "R163"), ("space", ["2"], "  "),
        ("split_part", ["'a-b-c'", "'-'", "2"], "b"), ("str_position", ["'hello'", "'l'"], "3"), ("stuff", ["'abcdef'", "2", "3", "'X'"], "aXef"), ("substring", ["'abcdef'", "2", "3"], "bcd"), ("substring_index", ["'a.b.c'", "'.'", "2"], "a.b"),
        ("translate", ["'abc'", "'ab'", "'xy'"], "xyc"), ("trim", ["'  a '"], "a"), ("unicode", ["'é'"], "233"), ("chr", ["8364"], "€"), ("chr", ["65"], "A"), ("chr", ["128578"], "🙂"), ("levenshtein", ["'kitten'", "'sitting'"], "3"),
        ("jarowinkler_similarity", ["'MARTHA'", "'MARHTA'"], "0.9611111111111111"), ("jarowinkler_similarity", ["'abc'", "'xyz'"], "0.0"), ("format", ["'%s-%d'", "'a'", "5"], "a-5"), ("number_to_str", ["1234.5", "2"], "1,234.50"),
        ("overlay", ["'abcdef'", "'XY'", "3"], "abXYef"), ("is_ascii", ["'abc'"], "true"), ("is_ascii", ["'é'"], "false"), ("normalize", ["'é'", "'NFC'"], "é"), ("regexp_count", ["'a1b2'", "'[0-9]'"], "2"), ("regexp_extract", ["'a12b'", "'([0-9]+)'", "1"], "12"),
        ("regexp_like", ["'abc'", "'^a'"], "true"), ("regexp_i_like", ["'A1'", "'a\\\\d'"], "true"), ("regexp_i_like", ["'A1'", "'a\\\\D'"], "false"), ("regexp_instr", ["'ab1'", "'[0-9]'"], "3"), ("regexp_replace", ["'a1b2'", "'[0-9]'", "'x'"], "axbx"),
        ("regexp_full_match", ["'abc'", "'a.c'"], "true"), ("regexp_full_match", ["'abcd'", "'a.c'"], "false"), ("search", ["'red fox runs'", "'fox red'"], "true"), ("search", ["'red fox'", "'foxes'"], "false"), ("match_against", ["'red fox'", "'blue fox'"], "true"),
        ("match_against", ["'red fox'", "'blue'"], "false"), ("parse_url", ["'https://a.b/c?d=1'", "'HOST'"], "a.b"), ("collate", ["'a'", "'UTF8_BINARY'"], "a"), ("collation", ["'a'"], "SYSTEM.BUILTIN.UTF8_BINARY"), ("code_points_to_string", ["array(97, 8364)"], "a€"),
        ("safe_convert_bytes_to_string", ["X'6162'"], "ab"), ("convert_to_charset", ["'ab'", "'UTF-8'"], "ab"), ("string", ["5"], "5"),
    ],
    "codes": [
        ("base64encode", ["CAST('ab' AS BINARY)"], "YWI="), ("to_base64", ["CAST('ab' AS BINARY)"], "YWI="), ("from_base64", ["'YWI='"], "ab"), ("base64decode_string", ["'YWI='"], "ab"), ("base64decode_binary", ["'YWI='"], "ab"), ("try_base64decode_string", ["'YWI='"], "ab"),
        ("try_base64decode_binary", ["'YWI='"], "ab"), ("to_base32", ["CAST('ab' AS BINARY)"], "MFRA===="), ("from_base32", ["'MFRA===='"], "ab"), ("from_base32", ["'!'"], None), ("hex", ["255"], "FF"), ("unhex", ["'6162'"], "ab"), ("hex_encode", ["'ab'"], "6162"),
        ("hex_decode_string", ["'6162'"], "ab"), ("try_hex_decode_binary", ["'6162'"], "ab"), ("try_hex_decode_string", ["'6162'"], "ab"), ("lower_hex", ["255"], "ff"), ("from_base", ["'ff'", "16"], "255"), ("encode", ["'ab'", "'UTF-8'"], "ab"), ("decode", ["X'6162'", "'UTF-8'"], "ab"),
        ("md5", ["'a'"], "0cc175b9c0f1b6a831c399e269772661"), ("sha", ["'a'"], "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"), ("sha2", ["'a'", "256"], "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("standard_hash", ["'a'"], "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"),
        ("standard_hash", ["'a'", "'MD5'"], "0cc175b9c0f1b6a831c399e269772661"), ("md5number_lower64", ["'a'"], "3585878926028121697"), ("md5number_upper64", ["'a'"], "919145239626757800"), ("code_points_to_bytes", ["array(97, 98)"], "ab"), ("to_code_points", ["'ab'"], "[97, 98]"),
        ("decompress_string", ["unhex('789c4b4a0200012600c4')"], None), ("decompress_binary", ["X'00'"], None), ("parse_ip", ["'10.0.0.1'"], "10.0.0.1"), ("parse_ip", ["'x'"], None), ("bitwise_count", ["7"], "3"), ("getbit", ["5", "2"], "1"),
    ],
    "numbers": [
        ("abs", ["-5"], "5"), ("acos", ["1D"], "0.0"), ("acosh", ["1D"], "0.0"), ("asin", ["0D"], "0.0"), ("asinh", ["0D"], "0.0"), ("atan", ["0D"], "0.0"), ("atan2", ["0D", "1D"], "0.0"), ("atanh", ["0D"], "0.0"), ("cbrt", ["27D"], "3.0"), ("ceil", ["1.2D"], "2"), ("cos", ["0D"], "1.0"),
        ("cosh", ["0D"], "1.0"), ("round", [f"cot(1D)", "6"], "0.642093"), ("round", ["csc(1D)", "6"], "1.188395"), ("sech", ["0"], "1.0"), ("round", ["1.2567D", "2"], "1.26"), ("degrees", ["0D"], "0.0"), ("exp", ["0D"], "1.0"), ("factorial", ["5"], "120"), ("floor", ["-1.2D"], "-2"),
        ("greatest", ["1", "3", "2"], "3"), ("least", ["1", "3", "2"], "1"), ("greatest_ignore_nulls", ["1", "NULL", "2"], "2"), ("least_ignore_nulls", ["1", "NULL", "2"], "1"), ("int_div", ["7", "2"], "3"), ("is_inf", ["double('infinity')"], "true"), ("is_nan", ["double('nan')"], "true"),
        ("ln", ["1D"], "0.0"), ("log", ["2D", "8D"], "3.0"), ("pow", ["2", "10"], "1024.0"), ("radians", ["0D"], "0.0"), ("sign", ["-3"], "-1.0"), ("sin", ["0D"], "0.0"), ("sinh", ["0D"], "0.0"), ("sqrt", ["9D"], "3.0"), ("square", ["4"], "16"), ("tan", ["0D"], "0.0"), ("tanh", ["0D"], "0.0"),
        ("width_bucket", ["5.35D", "0D", "10D", "5"], "3"), ("safe_add", ["9223372036854775807", "1"], None), ("safe_divide", ["1D", "0D"], None), ("safe_divide", ["6D", "3D"], "2.0"), ("safe_multiply", ["3", "4"], "12"), ("safe_negate", ["5"], "-5"), ("safe_subtract", ["5", "3"], "2"),
        ("bitwise_and", ["6", "3"], "2"), ("bitwise_or", ["6", "3"], "7"), ("bitwise_xor", ["6", "3"], "5"), ("bitwise_not", ["5"], "-6"), ("bitwise_left_shift", ["1", "3"], "8"), ("bitwise_right_shift", ["8", "2"], "2"), ("nullif0", ["0"], None), ("zeroifnull", ["NULL"], "0"),
        ("range_n", ["25", "0", "10"], "3"), ("range_bucket", ["20", "array(0, 10, 20, 30)"], "3"), ("cosine_distance", ["array(1D, 0D)", "array(0D, 1D)"], "1.0"), ("euclidean_distance", ["array(0D, 0D)", "array(3D, 4D)"], "5.0"), ("bitmap_bit_position", ["1"], "0"), ("bitmap_bucket_number", ["1"], "1"),
        ("bitmap_count", ["X'0103'"], "3"), ("pi", [], "3.141592653589793"), ("to_number", ["'454'", "'999'"], "454"), ("regr_valx", ["1", "2"], "2"), ("regr_valy", ["1", "2"], "1"), ("regr_valx", ["NULL", "2"], None),
    ],
    "logic": [
        ("booland", ["true", "false"], "false"), ("boolor", ["true", "false"], "true"), ("boolnot", ["true"], "false"), ("xor", ["true", "false"], "true"), ("and", ["true", "true"], "true"), ("or", ["false", "false"], "false"), ("coalesce", ["NULL", "2"], "2"), ("nullif", ["1", "1"], None), ("nvl2", ["NULL", "1", "2"], "2"),
        ("if", ["true", "1", "2"], "1"), ("case", ["false", "1", "true", "2", "3"], "2"), ("case", ["false", "1", "9"], "9"), ("decode_case", ["2", "1", "'a'", "2", "'b'", "'c'"], "b"), ("equal_null", ["NULL", "NULL"], "true"), ("cast", ["'5'", "int"], "5"), ("try_cast", ["'x'", "int"], None),
        ("convert", ["int", "'7'"], "7"), ("convert", ["'8'", "bigint"], "8"), ("cast_to_str_type", ["5"], "5"), ("float64", ["'1.5'"], "1.5"), ("int64", ["'12'"], "12"), ("to_double", ["'2.5'"], "2.5"), ("lax_int64", ["'x'"], None), ("lax_float64", ["'1.5'"], "1.5"), ("lax_bool", ["'true'"], "true"), ("lax_string", ["5"], "5"),
        ("parse_numeric", ["'1.5'"], "1.500000000"), ("parse_bignumeric", ["'2.25'"], "2.250000000"), ("typeof", ["1"], "int"), ("json_bool", ["'true'"], "true"),
    ],
    "times": [
        ("year", [_T], "2024"), ("quarter", [_T], "1"), ("month", [_T], "3"), ("day", [_T], "15"), ("hour", [_T], "13"), ("minute", [_T], "45"), ("second", [_T], "50"), ("day_of_month", [_T], "15"), ("day_of_week", [_T], "6"), ("day_of_week_iso", [_T], "5"), ("day_of_year", [_T], "75"), ("week", [_T], "11"), ("week_of_year", [_T], "11"),
        ("year_of_week", [_T], "2024"), ("year_of_week_iso", ["DATE '2021-01-03'"], "2020"), ("monthname", [_D], "Mar"), ("add_months", [_D, "1"], "2024-04-15"), ("date_add", [_D, "10"], "2024-03-25"), ("date_sub", [_D, "15"], "2024-02-29"), ("date_diff", [_D, "DATE '2024-03-01'"], "14"), ("date_trunc", ["'MONTH'", _T], "2024-03-01 00:00:00"),
        ("last_day", [_D], "2024-03-31"), ("next_day", [_D, "'MON'"], "2024-03-18"), ("previous_day", [_D, "'MON'"], "2024-03-11"), ("months_between", ["DATE '2024-05-15'", _D], "2.0"), ("date_from_parts", ["2024", "2", "29"], "2024-02-29"), ("timestamp_from_parts", ["2024", "2", "3", "4", "5", "6"], "2024-02-03 04:05:06"),
        ("timestamp_ltz_from_parts", ["2024", "2", "3", "4", "5", "6"], "2024-02-03 04:05:06"), ("timestamp_tz_from_parts", ["2024", "2", "3", "4", "5", "6"], "2024-02-03 04:05:06"), ("time_from_parts", ["1", "2", "3"], "01:02:03"), ("datetime_add", [_T, "INTERVAL 3 HOURS"], "2024-03-15 16:45:50"), ("datetime_add", [_T, "3", "HOUR"], "2024-03-15 16:45:50"),
        ("datetime_sub", [_T, "INTERVAL 1 DAY"], "2024-03-14 13:45:50"), ("datetime_sub", [_T, "2", "MINUTE"], "2024-03-15 13:43:50"), ("datetime_diff", [_T, "TIMESTAMP '2024-03-13 00:00:00'"], "2"), ("datetime_diff", [_T, "TIMESTAMP '2024-03-15 10:00:00'", "HOUR"], "3"), ("datetime_trunc", [_T, "'HOUR'"], "2024-03-15 13:00:00"),
        ("timestamp_add", [_T, "INTERVAL 10 SECONDS"], "2024-03-15 13:46:00"), ("timestamp_add", [_T, "1", "DAY"], "2024-03-16 13:45:50"), ("timestamp_sub", [_T, "INTERVAL 50 SECONDS"], "2024-03-15 13:45:00"), ("timestamp_sub", [_T, "1", "MONTH"], "2024-02-15 13:45:50"), ("timestamp_diff", [_T, "TIMESTAMP '2024-03-15 13:45:00'"], "50"),
        ("timestamp_diff", [_T, "TIMESTAMP '2024-03-14 00:00:00'", "DAY"], "1"), ("timestamp_trunc", [_T, "'DAY'"], "2024-03-15 00:00:00"), ("time_add", [_T, "INTERVAL 1 MINUTE"], "2024-03-15 13:46:50"), ("time_sub", [_T, "INTERVAL 1 MINUTE"], "2024-03-15 13:44:50"), ("ts_or_ds_add", [_D, "1"], "2024-03-16 00:00:00"), ("ts_or_ds_diff", [_D, "DATE '2024-03-10'"], "5"),
        ("date_bin", ["INTERVAL 15 MINUTES", _T], "2024-03-15 13:45:00"), ("date_bin", ["INTERVAL 1 HOUR", _T, "TIMESTAMP '2024-03-15 00:30:00'"], "2024-03-15 13:30:00"), ("date_bin", ["INTERVAL 1 DAY", "TIMESTAMP '1969-12-31 05:00:00'"], "1969-12-31 00:00:00"), ("time_slice", [_T, "6", "'HOUR'"], "2024-03-15 12:00:00"),
        ("to_days", ["DATE '0001-01-01'"], "366"), ("to_days", [_D], "739325"), ("unix_date", [_D], "19797"), ("unix_seconds", [_T], "1710510350"), ("unix_millis", [_T], "1710510350000"), ("unix_micros", [_T], "1710510350000000"), ("date_from_unix_date", ["19797"], "2024-03-15"), ("unix_to_time", ["0"], "1970-01-01 00:00:00"), ("unix_to_str", ["0"], "1970-01-01 00:00:00"),
        ("unix_to_time_str", ["0"], "1970-01-01 00:00:00"), ("time_to_unix", [_T], "1710510350"), ("time_to_str", [_T, "'yyyy/MM/dd'"], "2024/03/15"), ("str_to_time", ["'15.03.2024'", "'dd.MM.yyyy'"], "2024-03-15 00:00:00"), ("str_to_date", ["'2024-03-15'"], "2024-03-15"), ("str_to_unix", ["'1970-01-01 00:00:10'"], "10"), ("date_str_to_date", ["'2024-03-15'"], "2024-03-15"),
        ("date_to_date_str", [_D], "2024-03-15"), ("date_to_di", [_D], "20240315"), ("di_to_date", ["20240315"], "2024-03-15"), ("ts_or_di_to_di", [_T], "20240315"), ("ts_or_ds_to_date", ["'2024-03-15 01:02:03'"], "2024-03-15"), ("ts_or_ds_to_datetime", ["'2024-03-15 01:02:03'"], "2024-03-15 01:02:03"), ("ts_or_ds_to_date_str", [_T], "2024-03-15"),
        ("ts_or_ds_to_time", ["'2024-03-15 01:02:03'"], "2024-03-15 01:02:03"), ("ts_or_ds_to_timestamp", ["'2024-03-15 01:02:03'"], "2024-03-15 01:02:03"), ("time_str_to_date", ["'2024-03-15 01:02:03'"], "2024-03-15"), ("time_str_to_time", ["'2024-03-15 01:02:03'"], "2024-03-15 01:02:03"), ("time_str_to_unix", ["'1970-01-01 00:01:00'"], "60"),
        ("time_to_time_str", [_T], "2024-03-15 13:45:50"), ("from_iso8601timestamp", ["'2024-03-15T13:45:50'"], "2024-03-15 13:45:50"), ("parse_datetime", ["'2024-03-15 01:02:03'"], "2024-03-15 01:02:03"), ("parse_time", ["'2024-03-15 01:02:03'"], "2024-03-15 01:02:03"), ("datetime", ["'2024-03-15 01:02:03'"], "2024-03-15 01:02:03"), ("date", ["'2024-03-15'"], "2024-03-15"),
        ("timestamp", ["'2024-03-15 01:02:03'"], "2024-03-15 01:02:03"), ("to_char", ["454", "'999'"], "454"), ("convert_timezone", ["'UTC'", "'Asia/Tokyo'", "TIMESTAMP_NTZ '2024-03-15 00:00:00'"], "2024-03-15 09:00:00"), ("extract", ["DAY", _T], "15"), ("make_interval", ["1", "2"], "1 years 2 months"), ("justify_days", ["make_interval(0, 0, 0, 65)"], "2 months 5 days"),
        ("justify_hours", ["make_interval(0, 0, 0, 0, 50)"], "2 days 2 hours"), ("justify_interval", ["make_interval(0, 1, 0, 35, 25)"], "2 months 6 days 1 hours"), ("generate_date_array", [_D, "DATE '2024-03-17'"], "[2024-03-15, 2024-03-16, 2024-03-17]"), ("generate_date_array", [_D, "DATE '2024-04-20'", "INTERVAL 1 MONTH"], "[2024-03-15, 2024-04-15]"),
        ("generate_timestamp_array", ["TIMESTAMP '2024-03-15 00:00:00'", "TIMESTAMP '2024-03-15 02:00:00'", "INTERVAL 2 HOURS"], "[2024-03-15 00:00:00, 2024-03-15 02:00:00]"),
    ],
    "collections": [
        ("array_all", ["array(true, false)"], "false"), ("array_any", ["array(true, false)"], "true"), ("array_concat", ["array(1)", "array(2)", "array(3)"], "[1, 2, 3]"), ("array_construct_compact", ["1", "NULL", "2"], "[1, 2]"), ("array_contains", ["array(1, 2)", "2"], "true"), ("array_contains_all", ["array(1, 2, 3)", "array(1, 3)"], "true"),
        ("array_contains_all", ["array(1, 2)", "array(4)"], "false"), ("array_filter", ["array(1, 2, 3)", "x -> x > 1"], "[2, 3]"), ("array_first", ["array(4, 5)"], "4"), ("array_last", ["array(4, 5)"], "5"), ("array_intersect", ["array(1, 2)", "array(2, 3)"], "[2]"), ("array_length", ["array(1, 2)"], "2"), ("array_size", ["array(1, 2)"], "2"),
        ("array_overlaps", ["array(1)", "array(1, 2)"], "true"), ("array_remove", ["array(1, 2, 1)", "1"], "[2]"), ("array_reverse", ["array(1, 2)"], "[2, 1]"), ("array_slice", ["array(1, 2, 3)", "2", "2"], "[2, 3]"), ("array_sort", ["array(2, 1)"], "[1, 2]"), ("array_sum", ["array(1D, 2D)"], "3.0"), ("array_to_string", ["array('a', 'b')", "'-'"], "a-b"),
        ("apply", ["array(1, 2)", "x -> x + 1"], "[2, 3]"), ("transform", ["array(1, 2)", "x -> x * 2"], "[2, 4]"), ("reduce", ["array(1, 2, 3)", "0", "(a, x) -> a + x"], "6"), ("exists", ["array(1, 2)", "x -> x > 1"], "true"), ("flatten", ["array(array(1), array(2))"], "[1, 2]"), ("generate_series", ["1", "3"], "[1, 2, 3]"), ("generate_series", ["1", "9", "4"], "[1, 5, 9]"),
        ("get_extract", ["array(7, 8)", "2"], "8"), ("list", ["1", "2"], "[1, 2]"), ("to_array", ["1"], "[1]"), ("sort_array", ["array(2, 1)", "false"], "[2, 1]"), ("string_to_array", ["'a,b'", "','"], "[a, b]"), ("split", ["'a,b'", "','"], "[a, b]"), ("regexp_split", ["'a1b'", "'[0-9]'"], "[a, b]"), ("regexp_extract_all", ["'a1b2'", "'([0-9])'", "1"], "[1, 2]"),
        ("map", ["'a'", "1"], "{a -> 1}"), ("map_from_entries", ["array(struct('a', 1))"], "{a -> 1}"), ("to_map", ["array('a')", "array(1)"], "{a -> 1}"), ("star_map", ["array('a')", "array(1)"], "{a -> 1}"), ("var_map", ["array('a')", "array(1)"], "{a -> 1}"), ("str_to_map", ["'a:1,b:2'"], "{a -> 1, b -> 2}"), ("object_insert", ["map('a', 1)", "'b'", "2"], "{a -> 1, b -> 2}"),
        ("struct", ["1", "'a'"], "{1, a}"), ("struct_extract", ["named_struct('f', 5)", "f"], "5"), ("st_point", ["1D", "2D"], "{1.0, 2.0}"), ("xml_element", ["1 AS a"], "<ROW>\n    <a>1</a>\n</ROW>"), ("minhash_combine", ["array(1, 5)", "array(3, 2)"], "[1, 2]"), ("approximate_similarity", ["array(1, 2)", "array(1, 3)"], "0.5"),
    ],
    "json": [
        ("json_extract", [_J, "'$.a.b'"], "[1,2]"), ("json_extract_scalar", [_J, "'$.c'"], "x"), ("jsonb_extract", [_J, "'$.a'"], '{"b":[1,2]}'), ("jsonb_extract_scalar", [_J, "'$.a.b[1]'"], "2"), ("json_exists", [_J, "'$.c'"], "true"), ("jsonb_exists", [_J, "'$.z'"], "false"), ("json_extract_array", [_J, "'$.a.b'"], "[1, 2]"), ("json_value_array", [_J, "'$.a.b'"], "[1, 2]"),
        ("json_array", ["1", "2"], "[1,2]"), ("json_object", ["'a'", "1", "'b'", "'x'"], '{"a":1,"b":"x"}'), ("json_array_contains", ["'[1, 2]'", "2"], "true"), ("jsonb_contains", ["'[1, 2]'", "3"], "false"), ("jsonb_contains_all_top_keys", [_J, "array('a', 'c')"], "true"), ("jsonb_contains_any_top_keys", [_J, "array('z', 'c')"], "true"), ("json_format", ["struct(1 AS a)"], '{"a":1}'),
        ("json_cast", ["'{\"a\": 1}'"], '{"a":1}'), ("parse_json", ["'[1, 2]'"], "[1,2]"), ("json_type", ["'[1]'"], "ARRAY<BIGINT>"), ("is_null_value", ["parse_json('null')"], "true"), ("json_set", ["'{\"a\": 1}'", "'$.b'", "'2'"], '{"a": 1, "b": 2}'), ("json_set", ["'no json'", "'$.b'", "'2'"], None), ("json_set", ["'{}'", "'$.b'", "'{'"], None), ("json_remove", ["'{\"a\": 1, \"b\": 2}'", "'$.a'"], '{"b": 2}'),
        ("jsonb_delete_at_path", ["'{\"a\": [1, 2]}'", "'$.a[0]'"], '{"a": [2]}'), ("json_array_append", ["'{\"a\": [1]}'", "'$.a'", "'2'"], '{"a": [1, 2]}'), ("json_array_insert", ["'{\"a\": [1]}'", "'$.a[0]'", "'0'"], '{"a": [0, 1]}'), ("json_strip_nulls", ["'{\"a\": null, \"b\": 1}'"], '{"b": 1}'), ("json_keys_at_depth", ["'{\"a\": {\"b\": 1}}'", "2"], "[a, a.b]"), ("json_keys_at_depth", ["'x'", "1"], None),
    ],
}
