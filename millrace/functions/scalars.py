r"""Scalar and table functions, defined once as SQL functions.

Each body is plain Spark SQL, so Catalyst inlines it where it is called: no Python runs per
row, filters still reach the scan, and the analyzer checks argument counts and types before
a job starts. ``register(spark)`` makes the names visible to SQL; the functions below call
the same definitions from the DataFrame API.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The result text for undecodable input, the two-digit province codes, the
# weights of the 17 leading digits and the check characters by remainder.
DECODE_FAILED = "Base64解密失败"
PROVINCES = (
    11, 12, 13, 14, 15, 21, 22, 23, 31, 32, 33, 34, 35, 36, 37, 41, 42, 43, 44, 45, 46,
    50, 51, 52, 53, 54, 61, 62, 63, 64, 65, 71, 81, 82, 91,
)
WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CHECK_CHARS = "10X98765432"

_BLANK = r"(s IS NULL OR s rlike '^[\\x00-\\x20]*\\z')"

# base64() breaks lines every 76 characters; the result must not.
_ENCODE_BASE64 = rf"""
CASE WHEN {_BLANK} THEN NULL
     ELSE regexp_replace(base64(encode(s, 'utf-8')), '[\\r\\n]', '') END"""

# unbase64() skips what it cannot read, so the alphabet and the padding are checked first:
# padding may be missing, but where there is some it must complete a group of four.
_DECODE_BASE64 = rf"""
CASE WHEN {_BLANK} THEN NULL
     WHEN s rlike '^[A-Za-z0-9+/]*={{0,2}}\\z'
          AND length(rtrim('=', s)) % 4 <> 1
          AND (s NOT LIKE '%=' OR length(s) % 4 = 0)
     THEN make_valid_utf8(CAST(unbase64(s) AS STRING))
     ELSE '{DECODE_FAILED}' END"""

_ENCODE_MD5 = f"CASE WHEN {_BLANK} THEN NULL ELSE md5(encode(s, 'utf-8')) END"

# Offsets count UTF-16 units. The lengths between matches are summed in two levels (inside
# blocks of 256, then over blocks) so that a long text with many matches stays near linear.
_UTF16 = "CAST(octet_length(encode({0}, 'utf-16be')) / 2 AS INT)"
_BLOCK = 256


def _prefix_sums(array: str) -> str:
    """SQL: the running sums of an int array, as an array of the same length."""
    return (
        f"aggregate({array}, CAST(array() AS ARRAY<INT>),"
        " (acc, x) -> array_append(acc, coalesce(try_element_at(acc, -1), 0) + x))"
    )


_ALL_IN_STR = f"""
CASE WHEN s IS NULL OR find IS NULL OR find = '' THEN CAST(NULL AS ARRAY<INT>)
     WHEN NOT contains(s, find) THEN CAST(array() AS ARRAY<INT>)
     ELSE element_at(transform(array(
       transform(
         split(s, concat('\\\\Q', replace(find, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'), -1),
         p -> {_UTF16.format("p")} + {_UTF16.format("find")})
     ), gaps -> transform(
       element_at(transform(array(
         transform(sequence(0, CAST((size(gaps) - 2) / {_BLOCK} AS INT)),
           b -> {_prefix_sums(f"slice(gaps, b * {_BLOCK} + 1, least({_BLOCK}, size(gaps) - 1 - b * {_BLOCK}))")})
       ), blocks -> flatten(zip_with(
         blocks,
         {_prefix_sums("transform(blocks, x -> element_at(x, -1))")},
         (inside, upto) -> transform(inside, v -> v + upto - element_at(inside, -1))))), 1),
       e -> e - {_UTF16.format("find")})), 1) END"""

_BIRTHDAY = "CASE length(s) WHEN 15 THEN concat('19', substr(s, 7, 6)) WHEN 18 THEN substr(s, 7, 8) END"
# Lenient calendar: a month 1-12 and a day 1-31 are enough, also 31 February; no year 0.
_IS_DATE = f"""({_BIRTHDAY}) rlike '^(?!0000)[0-9]{{4}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])\\\\z'"""
_CHECK_SUM = (
    "aggregate(zip_with(split(substr(s, 1, 17), ''), array({weights}),"
    " (d, w) -> coalesce(try_cast(d AS INT), 0) * w), 0, (a, x) -> a + x)"
).format(weights=", ".join(map(str, WEIGHTS)))
_CHECK_ID_CARD = rf"""
CASE WHEN s IS NULL THEN NULL
     WHEN length(s) NOT IN (15, 18) THEN -1
     WHEN NOT ({_IS_DATE}) THEN -2
     WHEN NOT array_contains(array({", ".join(f"'{p}'" for p in PROVINCES)}), substr(s, 1, 2)) THEN -3
     WHEN length(s) = 15 THEN 0
     WHEN NOT substr(s, 1, 17) rlike '^[0-9]{{17}}\\z' THEN -4
     WHEN substr('{CHECK_CHARS}', {_CHECK_SUM} % 11 + 1, 1) <> substr(s, 18, 1) THEN -4
     ELSE 0 END"""

# A regex split that drops trailing empty pieces, but keeps '' as one empty piece.
_SPLIT_STR = """
CASE WHEN s IS NULL OR sep IS NULL THEN CAST(NULL AS ARRAY<STRING>)
     ELSE element_at(transform(array(split(s, sep, -1)), parts ->
       CASE WHEN size(parts) = 1 THEN parts
            WHEN NOT exists(parts, p -> p <> '') THEN CAST(array() AS ARRAY<STRING>)
            ELSE slice(parts, 1, CAST(size(parts) + 1
                 - array_position(reverse(transform(parts, p -> p <> '')), true) AS INT)) END), 1) END"""

# A variant keeps the kind of an array's elements: numbers are put in order as numbers, whatever they are written as.
_SORT_DESC = """
CASE WHEN a IS NULL THEN CAST(NULL AS ARRAY<STRING>)
     WHEN schema_of_variant(a) RLIKE '^ARRAY<(BIGINT|DECIMAL[(][0-9]+,0[)])>$'
       THEN CAST(sort_array(CAST(a AS ARRAY<DECIMAL(38,0)>), false) AS ARRAY<STRING>)
     WHEN schema_of_variant(a) RLIKE '^ARRAY<(DOUBLE|FLOAT|DECIMAL[(][0-9,]+[)])>$'
       THEN CAST(sort_array(CAST(a AS ARRAY<DOUBLE>), false) AS ARRAY<STRING>)
     WHEN schema_of_variant(a) RLIKE '^ARRAY<(STRING|DATE|TIMESTAMP|TIMESTAMP_NTZ|BOOLEAN|VOID)>$'
       THEN sort_array(CAST(a AS ARRAY<STRING>), false)
     ELSE CAST(raise_error(concat('sort_array_desc takes an array of one kind that has an order, not ', schema_of_variant(a))) AS ARRAY<STRING>) END"""

_SCALARS: dict[str, tuple[str, str, str]] = {
    "encode_base64": ("s STRING", "STRING", _ENCODE_BASE64),
    "decode_base64": ("s STRING", "STRING", _DECODE_BASE64),
    "encode_md5": ("s STRING", "STRING", _ENCODE_MD5),
    "all_in_str": ("s STRING, find STRING", "ARRAY<INT>", _ALL_IN_STR),
    "check_id_card": ("s STRING", "INT", _CHECK_ID_CARD),
    "count_distinct_array": ("a ARRAY<STRING>", "INT", "CASE WHEN a IS NOT NULL THEN size(array_distinct(a)) END"),
    "sort_array_desc": ("a VARIANT", "ARRAY<STRING>", _SORT_DESC),
    # SQL functions have one result type each: these give numbers as numbers.
    "sort_array_desc_long": ("a ARRAY<BIGINT>", "ARRAY<BIGINT>", "sort_array(a, false)"),
    "sort_array_desc_double": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "sort_array(a, false)"),
    "count_distinct_array_long": ("a ARRAY<BIGINT>", "INT", "CASE WHEN a IS NOT NULL THEN size(array_distinct(a)) END"),
    "count_distinct_array_double": ("a ARRAY<DOUBLE>", "INT", "CASE WHEN a IS NOT NULL THEN size(array_distinct(a)) END"),
    "uuid32": ("", "STRING", "replace(uuid(), '-', '')"),
    "split_str": ("s STRING, sep STRING", "ARRAY<STRING>", _SPLIT_STR),
}


def register(spark: SparkSession) -> None:
    """Create the SQL functions in this session.

    Scalars: ``encode_base64 decode_base64 encode_md5 all_in_str check_id_card
    count_distinct_array sort_array_desc split_str uuid32``, the two array functions also as
    ``…_long`` and ``…_double``. ``sort_array_desc`` takes an array of any kind that has an order and puts it in that
    order, as texts; nested and mixed arrays are errors. Table function:
    ``explode_str(s, sep)`` with column ``col``. ``uuid()`` and ``now()`` are built in.
    """
    for name, (params, result, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION explode_str(s STRING, sep STRING) RETURNS TABLE (col STRING)"
        f" RETURN SELECT explode({_SPLIT_STR})"
    )


def _caller(name: str) -> Callable[..., Column]:
    def call(*args: Column | str) -> Column:
        spark = SparkSession.getActiveSession()
        if spark is not None and not spark.catalog.functionExists(name):
            register(spark)
        return F.call_function(name, *(F.col(a) if isinstance(a, str) else a for a in args))

    call.__name__ = name
    return call


encode_base64 = _caller("encode_base64")
decode_base64 = _caller("decode_base64")
encode_md5 = _caller("encode_md5")
all_in_str = _caller("all_in_str")
check_id_card = _caller("check_id_card")
split_str = _caller("split_str")


def count_distinct_array(array: Column | str) -> Column:
    """Number of different elements; a null element counts once, a null array gives null."""
    column = F.col(array) if isinstance(array, str) else array
    return F.when(column.isNotNull(), F.size(F.array_distinct(column)))


def sort_array_desc(array: Column | str) -> Column:
    """The array in descending order, nulls last; works for any orderable element type."""
    return F.sort_array(array, asc=False)


def uuid32() -> Column:
    """A random UUID per row, 32 hex digits without dashes."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
