"""Functions visible from SQL and from the DataFrame API."""

from millrace.functions.aggregates import map_of, max_length_value, sum_value
from millrace.functions.arrays import combinations, subset_rows, subsets
from millrace.functions.jsons import kv_to_json, row_to_json, value_kinds
from millrace.functions.scalars import (
    all_in_str,
    check_id_card,
    count_distinct_array,
    decode_base64,
    encode_base64,
    encode_md5,
    register,
    sort_array_desc,
    split_str,
    uuid32,
)

__all__ = [
    "all_in_str",
    "check_id_card",
    "combinations",
    "count_distinct_array",
    "decode_base64",
    "encode_base64",
    "encode_md5",
    "kv_to_json",
    "map_of",
    "max_length_value",
    "register",
    "row_to_json",
    "sort_array_desc",
    "split_str",
    "subset_rows",
    "subsets",
    "sum_value",
    "uuid32",
    "value_kinds",
]
