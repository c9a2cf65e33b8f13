"""Functions that Spark has no expression for: Arrow-batched where they need Python, plain columns where they don't."""

from __future__ import annotations

import base64
import ipaddress
import json
import unicodedata
import zlib
from collections.abc import Callable
from functools import cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _null_safe(f: Callable[..., Any]) -> Callable[..., pd.Series]:
    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v, *a) for v, *a in zip(first, *rest, strict=True)], dtype=object)

    return run


def _path(path: str) -> list[str | int]:
    return [int(p) if p.isdigit() else p for p in path.removeprefix("$").replace("[", ".").replace("]", "").split(".") if p]


def _edit(text: str, path: str, change: Callable[[Any, Any], None]) -> str | None:
    try:
        doc = json.loads(text)
    except ValueError:
        return None
    steps = _path(path)
    if not steps:
        return text
    at = doc
    for s in steps[:-1]:
        try:
            at = at[s]
        except (KeyError, IndexError, TypeError):
            return json.dumps(doc)
    change(at, steps[-1])
    return json.dumps(doc)


def _set(at: Any, key: Any, value: Any) -> None:
    if isinstance(at, dict):
        at[str(key)] = value
    elif isinstance(at, list) and isinstance(key, int):
        at[key : key + 1] = [value]


def _drop(at: Any, key: Any) -> None:
    if isinstance(at, dict):
        at.pop(str(key), None)
    elif isinstance(at, list) and isinstance(key, int) and key < len(at):
        del at[key]


def _insert(at: Any, key: Any, value: Any) -> None:
    if isinstance(at, list) and isinstance(key, int):
        at.insert(key, value)


def _append(at: Any, key: Any, value: Any) -> None:
    try:
        if isinstance(at[key], list):
            at[key].append(value)
    except (KeyError, IndexError, TypeError):
        pass


def _strip(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _strip(x) for k, x in v.items() if x is not None}
    return [_strip(x) for x in v] if isinstance(v, list) else v


def _strip_nulls(text: str) -> str | None:
    try:
        return json.dumps(_strip(json.loads(text)))
    except ValueError:
        return None


def _keys(v: Any, depth: int, head: str = "") -> list[str]:
    if depth <= 0 or not isinstance(v, dict):
        return []
    return [x for k, y in v.items() for x in ([head + k] + _keys(y, depth - 1, f"{head}{k}."))]


def _or_null(f: Callable[[Any], Any]) -> Callable[[Any], Any]:
    """f, but null where its input isn't what it reads."""

    def run(v: Any) -> Any:
        try:
            return f(v)
        except (ValueError, zlib.error):
            return None

    return run


def _value(text: str | None) -> Any:
    return json.loads(text) if text is not None else None


def _changed(change: Callable[[Any, Any, Any], None]) -> Callable[[str, str, str | None], str | None]:
    """An edit by a JSON value; null where the text or the value isn't JSON."""

    def run(text: str, path: str, new: str | None) -> str | None:
        try:
            v = _value(new)
        except ValueError:
            return None
        return _edit(text, path, lambda a, k: change(a, k, v))

    return run


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of what is missing for each of up to four equal first signs."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    swapped = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def _ip(text: str) -> str | None:
    try:
        return ipaddress.ip_address(text).exploded
    except ValueError:
        return None


@cache
def _udf(name: str):
    table: dict[str, tuple[str, Callable[..., Any]]] = {
        "json_set": ("string", _changed(_set)),
        "json_remove": ("string", lambda t, p: _edit(t, p, _drop)),
        "jsonb_delete_at_path": ("string", lambda t, p: _edit(t, p, _drop)),
        "json_array_insert": ("string", _changed(_insert)),
        "json_array_append": ("string", _changed(_append)),
        "json_strip_nulls": ("string", _strip_nulls),
        "json_keys_at_depth": ("array<string>", lambda t, d: _or_null(lambda x: _keys(json.loads(x), int(d)))(t)),
        "to_base32": ("string", lambda b: base64.b32encode(bytes(b)).decode()),
        "from_base32": ("binary", _or_null(base64.b32decode)),
        "normalize": ("string", lambda t, form: unicodedata.normalize(form, t)),
        "compress": ("binary", lambda b: zlib.compress(bytes(b))),
        "decompress_binary": ("binary", _or_null(lambda b: zlib.decompress(bytes(b)))),
        "decompress_string": ("string", _or_null(lambda b: zlib.decompress(bytes(b)).decode())),
        "parse_ip": ("string", _ip),
        "jarowinkler_similarity": ("double", jaro_winkler),
    }
    kind, f = table[name]
    run = _null_safe(f)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf({1: one, 2: two, 3: three}[f.__code__.co_argcount], kind)


def call(name: str, *args: Column) -> Column:
    """A custom function by name."""
    if name == "st_distance":
        return haversine(*args)
    if name == "to_code_points":
        return F.transform(F.split(args[0], ""), F.ascii)
    if name == "code_points_to_string":
        return F.array_join(F.transform(args[0], lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")), "")
    if name == "minhash":
        return minhash(*args)
    if name == "minhash_combine":
        return F.zip_with(args[0], args[1], lambda x, y: F.least(x, y))
    if name == "approximate_similarity":
        return similarity(*args)
    return _udf(name)(*args)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere of the Earth's mean radius."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(h))


def minhash(words: Column, hashes: int = 64) -> Column:
    """The least of each of some hashes over an array's elements."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(words, lambda w: F.xxhash64(F.lit(seed), w)))

    return F.array(*map(least, range(hashes)))


def similarity(a: Column, b: Column) -> Column:
    """The share of equal places of two minhash signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def geometric_mean(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A user-defined aggregate: for each group the geometric mean of its positive values, null if it has none.

    Python adds up logarithms within each Arrow batch, and Spark what the batches say; no group is ever held as a whole.
    """

    def add(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            v = batch.column("_value")
            log = pc.ln(pc.if_else(pc.greater(v, 0), v, None))
            t = pa.table([*[batch.column(f"_key{i}") for i in range(len(keys))], log], names=[*named, "_log"])
            sums = t.group_by(named).aggregate([("_log", "sum"), ("_log", "count")])
            yield from sums.select([*named, "_log_sum", "_log_count"]).to_batches()

    named = [f"_key{i}" for i in range(len(keys))]
    own = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(value).cast("double").alias("_value"))
    kinds = "".join(f"{n} {dict(own.dtypes)[n]}, " for n in named)
    sums = own.mapInArrow(add, f"{kinds}_log_sum double, _log_count long").groupBy(*named)
    mean = F.exp(F.sum("_log_sum") / F.nullif(F.sum("_log_count"), F.lit(0)))
    return sums.agg(mean.alias("_mean")).select(*[F.col(n).alias(k) for n, k in zip(named, keys, strict=True)], F.col("_mean").alias(name))


def word_places():
    """A user-defined table function: (place, word) of a text's words."""

    class Places:
        def eval(self, text: str):
            for i, word in enumerate((text or "").split()):
                yield i, word

    return F.udtf(Places, returnType="place: int, word: string")
