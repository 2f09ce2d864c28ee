"""Password hashing: PBKDF2, scrypt, Argon2id and bcrypt, in Arrow batches.

The slow functions come from the standard library; Argon2id (RFC 9106) and
bcrypt are written out, on numpy and plain integers.  Equal (cleartext,
original) pairs are hashed once per batch.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SALT_BYTES, HASH_BYTES = 16, 32


def salt_of(original: str, use_salt: bool = True) -> bytes:
    """16 bytes of salt from the original value; zeros without salt."""
    return hashlib.sha256(original.encode()).digest()[:SALT_BYTES] if use_salt else bytes(SALT_BYTES)


def _shown(salt: bytes, key: bytes) -> str:
    return f"{salt.hex()}${key.hex()}"


def pbkdf2(cleartext: str, original: str, use_salt: bool = True, iterations: int = 600_000) -> str:
    salt = salt_of(original, use_salt)
    return _shown(salt, hashlib.pbkdf2_hmac("sha256", cleartext.encode(), salt, iterations, HASH_BYTES))


def scrypt(cleartext: str, original: str, use_salt: bool = True, n: int = 131072, r: int = 8, p: int = 1) -> str:
    salt = salt_of(original, use_salt)
    return _shown(salt, hashlib.scrypt(cleartext.encode(), salt=salt, n=n, r=r, p=p, maxmem=256 * n * r + (64 << 20), dklen=HASH_BYTES))


def _long_hash(data: bytes, length: int) -> bytes:
    """The variable-length hash of Argon2 over BLAKE2b."""
    head = struct.pack("<I", length)
    if length <= 64:
        return hashlib.blake2b(head + data, digest_size=length).digest()
    block = hashlib.blake2b(head + data).digest()
    out = block[:32]
    while length - len(out) > 64:
        block = hashlib.blake2b(block).digest()
        out += block[:32]
    return out + hashlib.blake2b(block, digest_size=length - len(out)).digest()


_LOW = np.uint64(0xFFFFFFFF)
#: Bytes of blocks that are worked on at once; a single hash may need more.
ARGON2_BYTES = 256 << 20


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    def add(x, y):
        return x + y + np.uint64(2) * (x & _LOW) * (y & _LOW)

    def turn(x, n):
        return (x >> np.uint64(n)) | (x << np.uint64(64 - n))

    for n1, n2 in ((32, 24), (16, 63)):
        a = add(a, b)
        d = turn(d ^ a, n1)
        c = add(c, d)
        b = turn(b ^ c, n2)
    return a, b, c, d


def _permute(v: np.ndarray) -> np.ndarray:
    """The round of BLAKE2b on each row of 16 words: columns, then diagonals, four at a time."""
    a, b, c, d = _mix(v[:, 0:4], v[:, 4:8], v[:, 8:12], v[:, 12:16])
    turned = lambda x, n: np.concatenate([x[:, n:], x[:, :n]], axis=1)
    a, b, c, d = _mix(a, turned(b, 1), turned(c, 2), turned(d, 3))
    return np.concatenate([a, turned(b, 3), turned(c, 2), turned(d, 1)], axis=1)


def _compress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The compression of each pair of blocks (rows of 128 words)."""
    r = x ^ y
    n = len(r)
    swapped = lambda v: v.reshape(n, 8, 8, 2).transpose(0, 2, 1, 3).reshape(n * 8, 16)
    rows = _permute(r.reshape(n * 8, 16))
    return swapped(_permute(swapped(rows))).reshape(n, 128) ^ r


def argon2id_many(passwords: list[bytes], salts: list[bytes], time: int, memory: int, lanes: int, length: int, secret: bytes = b"", data: bytes = b"") -> list[bytes]:
    """Argon2id, version 1.3 (memory in KiB), of many passwords in lockstep: all lanes of all of them take each step together."""
    n = len(passwords)
    width = 4 * (memory // (4 * lanes))
    quarter = width // 4
    block = np.zeros((n, lanes, width, 128), np.uint64)
    for k, (password, salt) in enumerate(zip(passwords, salts)):
        parts = [struct.pack("<6I", lanes, length, memory, time, 0x13, 2)]
        for piece in (password, salt, secret, data):
            parts += [struct.pack("<I", len(piece)), piece]
        start = hashlib.blake2b(b"".join(parts)).digest()
        for lane in range(lanes):
            for i in (0, 1):
                block[k, lane, i] = np.frombuffer(_long_hash(start + struct.pack("<2I", i, lane), 1024), np.uint64)
    own = np.arange(lanes)[None, :]
    which = np.arange(n)[:, None]
    zero = np.zeros((lanes, 128), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(time):
            for part in range(4):
                independent = t == 0 and part < 2
                counter = np.zeros((lanes, 128), np.uint64)
                counter[:, 0], counter[:, 1], counter[:, 2], counter[:, 3], counter[:, 4], counter[:, 5] = t, np.arange(lanes), part, lanes * width, time, 2
                addresses = zero
                first = 2 if t == 0 and part == 0 else 0
                # How many blocks a lane may refer to, beside those of the part at hand, and where they begin.
                before, origin = (part * quarter, 0) if t == 0 else (3 * quarter, (part + 1) % 4 * quarter)
                for i in range(first, quarter):
                    j = part * quarter + i
                    last = block[:, :, j - 1 if j else width - 1]
                    if independent:
                        if i == first or i % 128 == 0:
                            counter[:, 6] += np.uint64(1)
                            addresses = _compress(zero, _compress(zero, counter))
                        word = np.broadcast_to(addresses[:, i % 128], (n, lanes))
                    else:
                        word = last[:, :, 0]
                    j1 = word & _LOW
                    other = np.broadcast_to(own, (n, lanes)) if t == 0 and part == 0 else ((word >> np.uint64(32)) % np.uint64(lanes)).astype(np.int64)
                    size = before + np.where(other == own, i - 1, -1 if i == 0 else 0)
                    back = ((size.astype(np.uint64) * ((j1 * j1) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)
                    there = block[which, other, (origin + size - 1 - back) % width]
                    made = _compress(last.reshape(-1, 128), there.reshape(-1, 128)).reshape(n, lanes, 128)
                    block[:, :, j] = made if t == 0 else made ^ block[:, :, j]
    final = np.bitwise_xor.reduce(block[:, :, width - 1], axis=1)
    return [_long_hash(final[k].tobytes(), length) for k in range(n)]


def argon2id_raw(password: bytes, salt: bytes, time: int, memory: int, lanes: int, length: int, secret: bytes = b"", data: bytes = b"") -> bytes:
    return argon2id_many([password], [salt], time, memory, lanes, length, secret, data)[0]


def argon2id_batch(pairs: list[tuple[str, str]], use_salt: bool = True, time: int = 3, memory: int = 64 * 1024, threads: int = 4) -> list[str]:
    """Hashes of pairs of cleartext and original, as many at once as ``ARGON2_BYTES`` of blocks hold."""
    at_once = max(1, ARGON2_BYTES // (memory * 1024))
    made: list[str] = []
    for k in range(0, len(pairs), at_once):
        part = pairs[k : k + at_once]
        salts = [salt_of(o, use_salt) for _, o in part]
        made += [_shown(s, h) for s, h in zip(salts, argon2id_many([c.encode() for c, _ in part], salts, time, memory, threads, HASH_BYTES))]
    return made


def argon2id(cleartext: str, original: str, use_salt: bool = True, time: int = 3, memory: int = 64 * 1024, threads: int = 4) -> str:
    return argon2id_batch([(cleartext, original)], use_salt, time, memory, threads)[0]


@lru_cache(maxsize=1)
def _pi_words() -> list[int]:
    """The fraction of pi as 18 + 1024 words of 32 bits, by Machin's formula."""
    bits = 32 * (18 + 1024)
    one = 1 << (bits + 64)

    def inverse_tangent(n: int) -> int:
        term = total = one // n
        k, square = 1, n * n
        while term:
            term //= -square
            k += 2
            total += term // k if term >= 0 else -(-term // k)
        return total

    fraction = (4 * (4 * inverse_tangent(5) - inverse_tangent(239)) - 3 * one) >> 64
    return [(fraction >> (bits - 32 * (i + 1))) & 0xFFFFFFFF for i in range(18 + 1024)]


_BCRYPT64 = "./ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_PLAIN64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _to64(data: bytes) -> str:
    return base64.b64encode(data).decode().rstrip("=").translate(str.maketrans(_PLAIN64, _BCRYPT64))


def _from64(text: str) -> bytes:
    plain = text.translate(str.maketrans(_BCRYPT64, _PLAIN64))
    return base64.b64decode(plain + "=" * (-len(plain) % 4))


def _bcrypt_raw(password: bytes, salt: bytes, cost: int) -> bytes:
    words = _pi_words()
    p, s = list(words[:18]), list(words[18:])
    key = password[:72] + b"\0" if len(password) < 72 else password[:72]
    keys = [int.from_bytes(bytes(key[(4 * i + k) % len(key)] for k in range(4)), "big") for i in range(18)]
    salts = struct.unpack(">4I", salt)

    def encrypt(left: int, right: int) -> tuple[int, int]:
        for i in range(0, 16, 2):
            left ^= p[i]
            right ^= ((((s[left >> 24] + s[256 + (left >> 16 & 255)]) & 0xFFFFFFFF) ^ s[512 + (left >> 8 & 255)]) + s[768 + (left & 255)]) & 0xFFFFFFFF
            right ^= p[i + 1]
            left ^= ((((s[right >> 24] + s[256 + (right >> 16 & 255)]) & 0xFFFFFFFF) ^ s[512 + (right >> 8 & 255)]) + s[768 + (right & 255)]) & 0xFFFFFFFF
        return right ^ p[17], left ^ p[16]

    def expand(with_key: list[int] | None, with_salt: tuple[int, ...]) -> None:
        if with_key:
            for i in range(18):
                p[i] ^= with_key[i]
        left = right = at = 0
        for target in (p, s):
            for i in range(0, len(target), 2):
                left, right = encrypt(left ^ with_salt[at % 4], right ^ with_salt[(at + 1) % 4])
                at += 2
                target[i], target[i + 1] = left, right

    expand(keys, salts)
    salt_keys = [salts[i % 4] for i in range(18)]
    for _ in range(1 << cost):
        expand(keys, (0, 0, 0, 0))
        expand(salt_keys, (0, 0, 0, 0))
    out = list(struct.unpack(">6I", b"OrpheanBeholderScryDoubt"))
    for _ in range(64):
        for i in (0, 2, 4):
            out[i], out[i + 1] = encrypt(out[i], out[i + 1])
    return struct.pack(">6I", *out)[:23]


def _bcrypt_many(passwords: list[bytes], salts: list[bytes], cost: int) -> list[bytes]:
    """The same of many passwords in lockstep."""
    n = len(passwords)
    words = np.array(_pi_words(), np.uint32)
    p = np.repeat(words[:18, None], n, axis=1)
    s = np.repeat(words[None, 18:], n, axis=0).copy()
    flat, base = s.reshape(-1), np.arange(n) * 1024
    boxes = [base + 256 * k for k in range(4)]
    keys = np.empty((18, n), np.uint32)
    for k, password in enumerate(passwords):
        key = password[:72] + b"\0" if len(password) < 72 else password[:72]
        keys[:, k] = [int.from_bytes(bytes(key[(4 * i + c) % len(key)] for c in range(4)), "big") for i in range(18)]
    salt = np.array([struct.unpack(">4I", x) for x in salts], np.uint32).T
    low = np.uint32(255)

    def scramble(x: np.ndarray) -> np.ndarray:
        return ((flat[boxes[0] + (x >> np.uint32(24))] + flat[boxes[1] + (x >> np.uint32(16) & low)]) ^ flat[boxes[2] + (x >> np.uint32(8) & low)]) + flat[boxes[3] + (x & low)]

    def encrypt(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for i in range(0, 16, 2):
            left = left ^ p[i]
            right = right ^ scramble(left) ^ p[i + 1]
            left = left ^ scramble(right)
        return right ^ p[17], left ^ p[16]

    def expand(with_key: np.ndarray, with_salt: np.ndarray | None) -> None:
        nonlocal p
        p = p ^ with_key
        left = right = np.zeros(n, np.uint32)
        at = 0
        for i in range(0, 18 + 1024, 2):
            if with_salt is not None:
                left, right = left ^ with_salt[at % 4], right ^ with_salt[(at + 1) % 4]
                at += 2
            left, right = encrypt(left, right)
            if i < 18:
                p[i], p[i + 1] = left, right
            else:
                s[:, i - 18], s[:, i - 17] = left, right

    with np.errstate(over="ignore"):
        expand(keys, salt)
        salt_keys = salt[np.arange(18) % 4]
        for _ in range(1 << cost):
            expand(keys, None)
            expand(salt_keys, None)
        out = np.repeat(np.array(struct.unpack(">6I", b"OrpheanBeholderScryDoubt"), np.uint32)[:, None], n, axis=1)
        for _ in range(64):
            for i in (0, 2, 4):
                out[i], out[i + 1] = encrypt(out[i], out[i + 1])
    return [struct.pack(">6I", *(int(x) for x in out[:, k]))[:23] for k in range(n)]


def bcrypt_batch(pairs: list[tuple[str, str]], use_salt: bool = True, cost: int = 10) -> list[str]:
    """Hashes of the cleartexts of pairs, each with a salt of its own; few go one by one, many in lockstep."""
    if len(pairs) < BCRYPT_TOGETHER:
        return [bcrypt(c, cost=cost) for c, _ in pairs]
    salts = [os.urandom(16) for _ in pairs]
    return [f"$2a${cost:02d}${_to64(salt)}{_to64(raw)}" for salt, raw in zip(salts, _bcrypt_many([c.encode() for c, _ in pairs], salts, cost))]


#: From so many passwords on lockstep is faster than one by one.
BCRYPT_TOGETHER = 48


def bcrypt(cleartext: str, original: str = "", use_salt: bool = True, cost: int = 10, salt: bytes | None = None) -> str:
    """bcrypt with a random salt (so not deterministic), of the first 72 bytes of the cleartext."""
    salt = os.urandom(16) if salt is None else salt
    return f"$2a${cost:02d}${_to64(salt)}{_to64(_bcrypt_raw(cleartext.encode(), salt, cost))}"


def check_bcrypt(cleartext: str, hashed: str) -> bool:
    _, _, cost, rest = hashed.split("$")
    return hashed == bcrypt(cleartext, cost=int(cost), salt=_from64(rest[:22]))


METHODS: dict[str, tuple[Callable[..., str], dict[str, str]]] = {
    "PasswordBcrypt": (bcrypt, {"cost": "cost"}),
    "PasswordScrypt": (scrypt, {"n": "n", "r": "r", "p": "p"}),
    "PasswordPBKDF2": (pbkdf2, {"iterations": "iterations"}),
    "PasswordArgon2id": (argon2id, {"time": "time", "memory": "memory", "threads": "threads"}),
}


def hashed(kind: str, cleartext: Column, original: Column, use_salt: bool = True, **options: int) -> Column:
    """Hash of each cleartext, salted from the original (a NULL original salts like the empty text; a NULL cleartext gives NULL)."""
    method = METHODS[kind][0]

    def run(texts: pa.Array, originals: pa.Array) -> pa.Array:
        pairs = list(zip(texts.to_pylist(), originals.fill_null("").to_pylist()))
        if kind == "PasswordBcrypt":  # every row has its own salt
            made = iter(bcrypt_batch([p for p in pairs if p[0] is not None], use_salt, **options))
            return pa.array([None if t is None else next(made) for t, _ in pairs], pa.string())
        distinct = sorted({p for p in pairs if p[0] is not None})
        hashes = argon2id_batch(distinct, use_salt, **options) if kind == "PasswordArgon2id" else [method(c, o, use_salt, **options) for c, o in distinct]
        once = dict(zip(distinct, hashes))
        return pa.array([once.get(p) for p in pairs], pa.string())

    run.__annotations__ = {"texts": pa.Array, "originals": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, "string")
    return (udf.asNondeterministic() if kind == "PasswordBcrypt" else udf)(cleartext, original.cast("string"))
