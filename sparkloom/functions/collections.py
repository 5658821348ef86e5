"""Functions on strings, arrays and maps, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_string(s: Column, delimiter: str) -> Column:
    """Substrings between delimiters; one empty string at the end is left out, and an empty input gives none."""
    parts = F.split(s, F.regexp_replace(F.lit(delimiter), r"([\\.^$|?*+()\[\]{}])", r"\\$1"), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def string_slice(s: Column, start: int, end: int) -> Column:
    """UTF-8 bytes start..end-1 as binary, wherever characters end; null if end is past the length in bytes."""
    return F.when(F.octet_length(s) >= end, F.substring(F.encode(s, "UTF-8"), start + 1, end - start))


def string_bytes(s: Column) -> Column:
    return F.octet_length(s)


def array_push(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def array_pop(a: Column) -> Column:
    """struct(last: null if empty, rest)."""
    n = F.size(a)
    return F.struct(F.when(n > 0, F.element_at(a, F.when(n > 0, F.lit(-1)).otherwise(F.lit(1)))).alias("last"),
        F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("rest"))


def array_put(a: Column, at: int, x: Column) -> Column:
    return F.transform(a, lambda v, i: F.when(i == at, x).otherwise(v))


def array_push_at(a: Column, at: int, x: Column) -> Column:
    """The array with x in place of the element at `at`; null where there is no such place."""
    return F.when(F.size(a) > at, array_put(a, at, x))


def array_pop_at(a: Column, at: int) -> Column:
    """The element at `at`, or null past the end; the array keeps its length, since its owner reuses the place."""
    return F.get(a, F.lit(at))


def array_truncate(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.least(F.size(a), F.lit(n)))


def array_cut(a: Column, start: int, n: int) -> Column:
    return F.slice(a, start + 1, n)


def array_bounded_push(a: Column, x: Column, capacity: int) -> Column:
    """The array with x, or unchanged where it is full."""
    return F.when(F.size(a) < capacity, F.array_append(a, x)).otherwise(a)


def array_find(a: Column, test) -> Column:
    """Place (from 0) of the first element that passes, else null."""
    return F.get(F.filter(F.transform(a, lambda v, i: F.when(test(v), i)), lambda i: i.isNotNull()), F.lit(0))


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many elements two arrays share, equal ones as often as the lesser count."""
    each = F.transform(F.array_distinct(a), lambda x: F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.aggregate(each, F.lit(0), lambda n, k: n + k)


def map_intersection(a: Column, b: Column, choose) -> Column:
    """Keys of both; choose(a's value, b's value) gives the value."""
    both = F.map_filter(a, lambda k, _: F.map_contains_key(b, k))
    return F.transform_values(both, lambda k, v: choose(v, F.element_at(b, k)))


def map_difference(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))


def map_union(a: Column, b: Column, choose) -> Column:
    """All keys; choose decides where both have one."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(~F.map_contains_key(b, k), x).when(~F.map_contains_key(a, k), y).otherwise(choose(x, y)))


def rmw_step(v: Column) -> Column:
    """Absent becomes 1; under 100000 doubles; else adds 1."""
    return F.when(v.isNull(), F.lit(1)).when(v < 100000, v * 2).otherwise(v + 1).cast("long")


def rmw_after(start: Column, times: Column) -> Column:
    """The value after `times` steps, in closed form: doublings until 100000 is reached, then counting. Values of 0 or less
    never get there: 0 stays and a negative one doubles each time. Beyond 64 bits it is an error, as each step would be."""
    first = F.when(start.isNull(), F.lit(1)).otherwise(start).cast("long")
    left = (times - F.when(start.isNull(), 1).otherwise(0)).cast("long")
    need = F.when(first >= 100000, 0).when(first <= 0, left).otherwise(F.ceil(F.log2(F.lit(100000.0) / first)))
    doubled = F.least(need, left)
    factor = F.pow(F.lit(2.0), F.when((times <= 0) | (first == 0), F.lit(0)).otherwise(doubled)).cast("long")
    return F.when(times <= 0, start.cast("long")).otherwise(first * factor + left - doubled)


def bucket_of(key: Column, n: int) -> Column:
    """A key's bucket: the first 32 bits of its MD5 digest modulo n, which any other system can compute too."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n))


def group_buckets(buckets: int, groups: int) -> list[tuple[int, int]]:
    """At most `groups` ranges of ceil(buckets / groups) buckets."""
    size = -(-buckets // groups)
    return [(a, min(a + size, buckets)) for a in range(0, buckets, size)]


def bit_is_set(bits: Column, at: Column) -> Column:
    return F.bit_get(bits, at) == 1


def bit_set(bits: Column, at: int) -> Column:
    return bits.bitwiseOR(F.lit(1 << at))
