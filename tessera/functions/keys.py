"""Keys, digests and paths of objects, as columns."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 16


def text(c: Column) -> Column:
    return c.cast("string")


def prefix_key(tokens: Column, n: Column | int, model: Column | str) -> Column:
    """The first 32 hex digits of sha256 over `model:tok,tok,...` of the first n tokens."""
    n = F.lit(n) if isinstance(n, int) else n
    model = F.lit(model) if isinstance(model, str) else model
    body = F.array_join(F.transform(F.slice(tokens, 1, n.cast("int")), text), ",")
    return F.substring(F.sha2(F.concat(model, F.lit(":"), body), 256), 1, 32)


def block_count(tokens: Column, block: int = BLOCK) -> Column:
    return F.floor(F.size(tokens) / block).cast("int")


def cacheable(tokens: Column, block: int = BLOCK) -> Column:
    """Tokens in full blocks; the trailing part of a block doesn't count."""
    return block_count(tokens, block) * block


def block_key(tokens: Column, index: Column, model: Column | str, block: int = BLOCK) -> Column:
    return prefix_key(tokens, (index + 1) * block, model)


def block_keys(tokens: Column, model: Column | str, block: int = BLOCK) -> Column:
    """The keys of all full blocks, each over the whole prefix. Quadratic in the tokens, and within
    generated code: for prompts. Long sequences take block_keys_linear."""
    n = block_count(tokens, block)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: block_key(tokens, i, model, block))
    return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))


def block_keys_linear(tokens: Column, model: Column, block: int = BLOCK) -> Column:
    """The same keys in one pass over the tokens, as the state of sha256 is copied at each block."""

    @F.pandas_udf("array<string>")
    def keys(lists: pd.Series, models: pd.Series) -> pd.Series:
        def of(ids, name):
            if ids is None:
                return None
            state, out = hashlib.sha256(f"{name}:".encode()), []
            for i in range(len(ids) // block):
                part = ",".join(str(int(x)) for x in ids[i * block : (i + 1) * block])
                state.update(("," * (i > 0) + part).encode())
                out.append(state.copy().hexdigest()[:32])
            return out

        return pd.Series([of(a, b) for a, b in zip(lists, models, strict=True)])

    return keys(tokens, model)


def canonical_key(namespace: Column, key: Column) -> Column:
    """`<bytes of namespace>:<namespace><key>`."""
    return F.concat(F.octet_length(namespace).cast("string"), F.lit(":"), namespace, key)


def parse_canonical(canonical: Column) -> tuple[Column, Column]:
    """namespace and key; null where the length isn't a number or runs past the end."""
    size = F.try_to_number(F.split_part(canonical, F.lit(":"), F.lit(1)), F.lit("9999999999")).cast("int")
    start = F.length(F.split_part(canonical, F.lit(":"), F.lit(1))) + 2
    raw = canonical.cast("binary")
    ok = size.isNotNull() & (start - 1 + size <= F.octet_length(canonical))
    cut = lambda at, n: F.decode(F.substring(raw, at, n), "UTF-8")
    return F.when(ok, cut(start, size)), F.when(ok, cut(start + size, F.octet_length(canonical)))


def object_digest(namespace: Column, key: Column) -> Column:
    return F.md5(canonical_key(namespace, key).cast("binary"))


def backend_key(key: Column, layer: Column) -> Column:
    """`<length of key>:<key><layer>`, the flat key of a (key, layer) pair."""
    return F.concat(F.octet_length(key).cast("string"), F.lit(":"), key, layer)


def percent_encode(c: Column) -> Column:
    """RFC 3986 with no safe characters."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def block_store_key(layout: Column, namespace: Column, model: Column, sequence: Column, prefix: Column, rank: Column, index: Column) -> Column:
    """Eight parts joined by colons; an empty or missing prefix hash is a dash."""
    prefix = F.when(F.coalesce(prefix, F.lit("")) == "", F.lit("-")).otherwise(prefix)
    return F.concat_ws(":", F.lit("kvbm"), *(percent_encode(c) for c in (layout, namespace, model, sequence, prefix)), F.concat(F.lit("tp"), text(rank)), F.concat(F.lit("b"), text(index)))


def layer_name(blocks: Column, rank: Column, tp_size: Column) -> Column:
    return F.concat(F.lit("blocks_"), text(blocks), F.when(tp_size > 1, F.concat(F.lit("_tp"), text(rank))).otherwise(""))


def lane_name(layer: Column, lane: Column, lanes: Column) -> Column:
    return F.concat(layer, F.lit("_p"), text(lane), F.lit("of"), text(lanes))


def path_component(c: Column) -> Column:
    safe = F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")
    return F.when(safe.isin("", ".", ".."), "_").otherwise(safe)


def object_path(root: Column, namespace: Column, key: Column, suffix: Column) -> Column:
    d = object_digest(namespace, key)
    return F.concat_ws("/", root, F.lit("data"), path_component(namespace), F.substring(d, 1, 2), F.substring(d, 3, 2), F.concat(F.substring(d, 5, 28), suffix, F.lit(".bin")))


def versioned_path(root: Column, namespace: Column, key: Column, generation: Column, layout: Column, chunk: Column | None = None) -> Column:
    suffix = F.concat(F.lit(".g"), text(generation), F.lit(".l"), text(layout))
    return object_path(root, namespace, key, suffix if chunk is None else F.concat(suffix, F.lit(".chunk"), text(chunk)))


def plain_path(root: Column, namespace: Column, key: Column, chunk: Column | None = None) -> Column:
    """The path without versions that earlier layouts used."""
    return object_path(root, namespace, key, F.lit("") if chunk is None else F.concat(F.lit(".chunk"), text(chunk)))


def endpoint_uri(endpoint: Column) -> Column:
    return F.when(endpoint.startswith("http://") | endpoint.startswith("https://"), endpoint).otherwise(F.concat(F.lit("http://"), endpoint))


def device_number(key: Column) -> Column:
    return F.crc32(key.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)) + 1


def hex_name(key: Column) -> Column:
    return F.lower(F.hex(key.cast("binary")))


def parse_size(c: Column) -> Column:
    """Bytes of `512m`, `4k`, `1g` or a plain number."""
    low = F.lower(F.trim(c))
    number = F.regexp_extract(low, "^([0-9]+)", 1).cast("long")
    unit = F.substring(low, -1, 1)
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return number * factor.cast("long")
