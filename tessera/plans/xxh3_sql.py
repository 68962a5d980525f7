"""XXH3-64 as DuckDB SQL, written out from the algorithm's public specification, for the SQL of queries that hash."""

from __future__ import annotations

#: The algorithm's secret and its primes.
SECRET = bytes.fromhex(
    "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"
    "3c2852bb91c300cb88d0658b1b532ea371644897a20df94e3819ef46a9deacd8a8fa763fe39c343ff9dcbbc7c70b4f1d8a51e04bcdb45931c89f7ec9d9787364"
    "eac5ac8334d3ebc3c581a0fffa1363eb170ddd51b7f0da49d316552629d4689e2b16be587d47a1fc8ff8b8d17ad031ce45cb3a8f95160428afd7fbcabb4b407e"
)
P32 = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
P64 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
MODULUS = "18446744073709551616::UHUGEINT"


def word(o: int, size: int = 8) -> int:
    """A little-endian number of the secret."""
    return int.from_bytes(SECRET[o : o + size], "little")


def let(name: str, value: str, body: str) -> str:
    """body with a name for a value."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def wrap(x: str) -> str:
    """x modulo 2 ** 64."""
    return f"(({x}) % {MODULUS})::UBIGINT"


def u(x: int) -> str:
    return f"{x}::UBIGINT"


def big(x: str) -> str:
    return f"({x})::UHUGEINT"


def read(o: int | str, size: int = 8) -> str:
    """A little-endian number of the input, whose bytes are in h as hex digits."""
    pairs = " || ".join(f"substr(h, 2 * ({o}) + {2 * k + 1}, 2)" for k in reversed(range(size)))
    return f"coalesce(try_cast('0x' || {pairs} AS UBIGINT), 0::UBIGINT)"


def fold(a: str, b: str) -> str:
    """The halves of a product of 128 bits, one over the other."""
    return let("p", f"{big(a)} * {big(b)}", f"xor((p % {MODULUS})::UBIGINT, (p // {MODULUS})::UBIGINT)")


def mix(o: int | str, s: int) -> str:
    return fold(f"xor({read(o)}, {u(word(s))})", f"xor({read(f'{o} + 8')}, {u(word(s + 8))})")


def shifted(x: str, k: int) -> str:
    return f"xor({x}, {x} >> {k})"


def avalanche(x: str) -> str:
    return let("a", x, let("b", wrap(f"{big(shifted('a', 37))} * {0x165667919E3779F9}::UHUGEINT"), shifted("b", 32)))


def avalanche64(x: str) -> str:
    return let("a", x, let("b", wrap(f"{big(shifted('a', 33))} * {P64[1]}::UHUGEINT"), let("c", wrap(f"{big(shifted('b', 29))} * {P64[2]}::UHUGEINT"), shifted("c", 32))))


def rotated(x: str, k: int) -> str:
    return wrap(f"{big(x)} * {1 << k}::UHUGEINT") + f" + ({x} >> {64 - k})"


def total(terms: list[str]) -> str:
    return wrap(" + ".join(big(t) for t in terms))


def hash_sql(x: str) -> str:
    """The hash of a text's bytes, as an unsigned number."""
    byte = lambda o: f"('0x' || substr(h, 2 * ({o}) + 1, 2))::UBIGINT"
    empty = avalanche64(u(word(56) ^ word(64)))
    few = avalanche64(f"xor(({byte(0)} << 16) | ({byte('n // 2')} << 24) | {byte('n - 1')} | (n::UBIGINT << 8), {u(word(0, 4) ^ word(4, 4))})")
    odd = 0x9FB21C651E98DF25
    four = let("k", f"xor({wrap(big(read('n - 4', 4)) + ' + ' + big(read(0, 4)) + f' * {1 << 32}::UHUGEINT')}, {u(word(8) ^ word(16))})",
        let("a", f"xor(xor(k, {rotated('k', 49)}), {rotated('k', 24)})", let("b", wrap(f"{big('a')} * {odd}::UHUGEINT"),
        let("c", f"xor(b, {wrap(big('b >> 35') + ' + n')})", let("d", wrap(f"{big('c')} * {odd}::UHUGEINT"), shifted("d", 28))))))
    digits = "lpad(hex(lo), 16, '0')"
    swap = "coalesce(try_cast('0x' || " + " || ".join(f"{digits}[{k}:{k + 1}]" for k in range(15, 0, -2)) + " AS UBIGINT), 0)"
    nine = let("lo", f"xor({read(0)}, {u(word(24) ^ word(32))})", let("hi", f"xor({read('n - 8')}, {u(word(40) ^ word(48))})", avalanche(total(["n", swap, "hi", fold("lo", "hi")]))))
    start = f"n::UHUGEINT * {P64[0]}::UHUGEINT"
    pairs = [mix(0, 0), mix("n - 16", 16)] + [f"CASE WHEN n > {32 * k} THEN {big(mix(16 * k, 32 * k))} + {big(mix(f'n - {16 * k + 16}', 32 * k + 16))} ELSE 0::UHUGEINT END" for k in (1, 2, 3)]
    middle = avalanche(total([start, *pairs]))
    first = avalanche(total([start, *(mix(16 * k, 16 * k) for k in range(8))]))
    later = [f"CASE WHEN n >= {16 * k + 16} THEN {big(mix(16 * k, 16 * (k - 8) + 3))} ELSE 0::UHUGEINT END" for k in range(8, 15)]
    upper = avalanche(total([first, *later, mix("n - 16", 136 - 17)]))
    # eight lanes over stripes of 64 bytes in blocks of 16, scrambled after each whole block; the last stripe once more from the end
    keys = [word(8 * k) for k in range(16 + 8)]
    last = [word(192 - 64 - 7 + 8 * k) for k in range(8)]
    lanes = []
    init = (P32[2], P64[0], P64[1], P64[2], P64[3], P32[1], P64[4], P32[0])

    def product(o: str, key: str) -> str:
        return let("k", f"xor({read(o)}, {key})", "(k & 4294967295)::UHUGEINT * (k >> 32)::UHUGEINT")

    for i in range(8):
        def stripes(block: str, count: str, i: int = i) -> str:
            at = f"1024 * {block} + 64 * t"
            one = f"({product(f'{at} + {8 * i}', f'list_extract({keys}::UBIGINT[24], t + {i + 1})')} + {big(read(f'{at} + {8 * (i ^ 1)}'))}) % {MODULUS}"
            return f"coalesce(list_sum(list_transform(range({count}), lambda t: ({one})::HUGEINT)), 0)::UHUGEINT"

        scrambled = let("x", wrap("acc + s"), let("y", f"xor({shifted('x', 47)}, {u(word(128 + 8 * i))})", f"(y::UHUGEINT * {P32[0]}::UHUGEINT) % {MODULUS}"))
        whole = f"list_reduce(list_concat([{init[i]}::UHUGEINT], list_transform(range((n - 1) // 1024), lambda b: {stripes('b', '16')})), lambda acc, s: {scrambled})"
        rest = stripes("((n - 1) // 1024)", "(n - 1) % 1024 // 64")
        lanes.append(f"(({whole} + {rest} + {product(f'n - 64 + {8 * i}', u(last[i]))} + {big(read(f'n - 64 + {8 * (i ^ 1)}'))}) % {MODULUS})::UBIGINT")
    long = avalanche(total([start, *(fold(f"xor({lanes[2 * k]}, {u(word(11 + 16 * k))})", f"xor({lanes[2 * k + 1]}, {u(word(11 + 16 * k + 8))})") for k in range(4))]))
    body = f"CASE WHEN n = 0 THEN {empty} WHEN n <= 3 THEN {few} WHEN n <= 8 THEN {four} WHEN n <= 16 THEN {nine} WHEN n <= 128 THEN {middle} WHEN n <= 240 THEN {upper} ELSE {long} END"
    return let("h", f"hex(encode({x}))", let("n", "(length(h) // 2)", body))


def hex_sql(x: str) -> str:
    return f"lower(lpad(hex({hash_sql(x)}), 16, '0'))"
