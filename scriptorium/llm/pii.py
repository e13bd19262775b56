"""Format-preserving pseudonyms for personal data (DataFrame functions only).

One pattern finds e-mail addresses, phone numbers, card numbers, IPv4 addresses, dates and
quoted secrets; card numbers must pass the Luhn check, addresses and dates must be valid, all
else is left alone.  A match becomes a list of symbols, each with the size of its alphabet
(digits, letters of one case, octets, the two parts of a day number).  A keyed Feistel network
permutes the list: in each round one half is shifted, symbol by symbol and modulo its alphabet,
by a keyed hash of the other half.  The map is a permutation of the values of one format, so
equal values get equal pseudonyms in all documents and different values different ones; with
the key it can be undone (`restored`).  Of phone and card numbers only the digits are permuted
(of phones the last ten), so one number in two layouts stays linked.

The key is the caller's.  Keys of the rounds are derived from it and lie in a one-row table in the
shared folder that only the owner may read; plans, event logs and Spark's pages show its path, never
a key.  `session_key` is an error where no key is set.  The registered query and the pipeline take
`stored_keys`: without a setting, a random key that is made once and kept in the shared folder, so
that all runs over it are linked and can be undone.

Edge cases: a null text stays null; texts without a match are unchanged; dates outside
1900-01-01 + 73200 days, cards without a valid check digit and octets over 255 are unchanged;
repeated rows get equal texts; an empty table gives an empty result; all other columns stay as
they are, and a length column follows its text only where it held the length before.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, shared_dir

ROUNDS = 8
#: Setting of the session that holds the key.
KEY_SETTING = "spark.scriptorium.pseudonym.key"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IN, _OUT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
PHONE = _IN + r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}" + _OUT
CARD = _IN + r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})" + _OUT
IP = r"(?<![\p{L}\p{N}.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![\p{L}\p{N}]|\.\d)"
DATE = _IN + r"(?:\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4})" + _OUT
SECRET = r"(?i:token|secret|password|api[_-]?key)\s*[=:]\s*\"[0-9A-Fa-f]{8,}\""
PATTERN = "|".join((EMAIL, SECRET, PHONE, IP, DATE, CARD))
#: Every match holds one of these, which most texts do not.
HINT = r"[@0-9\"]"
#: First day of the dates that are permuted, and the sizes of the two parts of a day number.
FIRST_DAY, HIGH, LOW = "1900-01-01", 400, 183

DIGITS = "0123456789"
SMALL = "abcdefghijklmnopqrstuvwxyz"
SMALL_LATIN = "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)
LARGE_LATIN = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
ALPHABETS = (DIGITS, SMALL, SMALL.upper(), SMALL_LATIN, LARGE_LATIN)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    n = F.char_length(digits)

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((n - i) % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.regexp_extract_all(digits, F.lit("(\\d)"), F.lit(1)), weigh), F.lit(0), lambda a, d: a + d)


def _symbol(c: Column, active: Column, first: Column | None) -> Column:
    """(c, x, m, a): the character, its place in its alphabet of m characters; m = 1 leaves it fixed.

    `first` is an alphabet that goes before the others.
    """
    alphabets = ALPHABETS if first is None else ("ABCDEF",)
    a = F.when(F.lit(False), "") if first is None else F.when(F.contains(first, c), first)
    for alphabet in alphabets:
        a = a.when(F.contains(F.lit(alphabet), c), alphabet)
    a = F.when(active, a).otherwise("")
    place = lambda a: F.greatest(F.call_function("locate", c, a) - 1, F.lit(0))
    size = lambda a: F.greatest(F.char_length(a), F.lit(1))
    return let(F.coalesce(a, F.lit("")), lambda a: F.struct(c.alias("c"), place(a).alias("x"), size(a).alias("m"), a.alias("a")))


def _number(x: Column, m: int) -> Column:
    return F.struct(F.lit("").alias("c"), x.cast("int").alias("x"), F.lit(m).alias("m"), F.lit("").alias("a"))


def _permuted(v: Column, key: Column, undo: bool) -> Column:
    """The Feistel network over a list of symbols."""
    for r in range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS):
        step = lambda s: _round(s, r, key, undo)  # noqa: B023, E731  (called at once)
        v = let(v, step)
    return v


def _round(s: Column, r: int, key: Column, undo: bool) -> Column:
    half = F.floor(F.size(s) / 2).cast("int")
    first = r % 2 == 0
    other = F.slice(s, half + 1, F.size(s) - half) if first else F.slice(s, F.lit(1), half)
    digest = F.concat_ws("|", key[r], F.size(s).cast("string"), F.array_join(F.transform(other, lambda t: t["x"].cast("string")), ","))

    def shift(d: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            hashed = F.sha2(F.concat_ws("|", d, F.floor(i / 16).cast("string")), 256)
            by = F.conv(F.substring(hashed, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            mine = (i < half) if first else (i >= half)
            x = F.pmod(t["x"] - by if undo else t["x"] + by, t["m"])
            return F.struct(t["c"].alias("c"), F.when(mine & (t["m"] > 1), x).otherwise(t["x"]).alias("x"), t["m"].alias("m"), t["a"].alias("a"))

        return F.transform(s, one)

    return let(digest, shift)


def _characters(x: Column, low: Column, high: Column, first: Column | None = None) -> Column:
    """Symbols of a string; those at places in [low, high) may change."""
    return F.transform(F.regexp_extract_all(x, F.lit("(?s)(.)"), F.lit(1)), lambda c, i: _symbol(c, (i >= low) & (i < high), first))


def _digits_in(x: Column, digits: Column) -> Column:
    """`x` with its digits, in order, replaced by those of the string `digits`; all else stays where it is."""
    n = F.char_length(digits)

    def place(c: Column, i: Column) -> Column:
        seen = F.char_length(F.regexp_replace(F.substring(x, F.lit(1), i + 1), r"\D", ""))
        own = n - F.char_length(F.regexp_replace(x, r"\D", "")) + seen
        return F.when(c.rlike(r"^\d$") & (own > 0), F.substring(digits, own, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)(.)"), F.lit(1)), place), "")


def _text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda s: F.when(s["m"] == 1, s["c"]).otherwise(F.substring(s["a"], s["x"] + 1, F.lit(1)))), "")


def _replace(x: Column, key: Column, undo: bool) -> Column:
    """Pseudonym of one match."""
    n = F.char_length(x)
    everything = F.lit(1 << 30)
    email, secret, phone, ip = x.contains("@"), x.endswith('"'), x.rlike(f"^(?:{PHONE})$"), x.rlike(f"^(?:{IP})$")
    # Local part and all of the domain but its last two labels.
    kept = F.char_length(F.regexp_extract(x, r"([^.@]+\.[^.@]+)$", 1))
    small = F.regexp_extract(x, '"(.*)"', 1).rlike("[a-f]")
    hexadecimal = F.when(small, DIGITS + "abcdef").otherwise(DIGITS + "ABCDEF")
    digits = F.regexp_replace(x, r"\D", "")
    iso = x.rlike(r"^\d{4}-")
    day = F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.replace(x, F.lit("."), F.lit("/")), F.lit("dd/MM/yyyy"))).cast("date")
    nth = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))

    def moved(symbols: Column) -> Column:
        return _permuted(symbols, key, undo)

    def number(part: Column) -> Column:
        return _text(moved(_characters(part, F.lit(0), everything)))

    def card(body: Column) -> Column:
        check = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10))
        return _digits_in(x, F.concat(body, check.cast("string")))

    def date(v: Column) -> Column:
        d = F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(v, 0)["x"] * LOW + F.get(v, 1)["x"])
        slash = F.date_format(d, "dd/MM/yyyy")
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(x.contains("."), F.replace(slash, F.lit("/"), F.lit("."))).otherwise(slash)

    octets = F.transform(F.split(x, r"\."), lambda o: _number(o, 256))
    dated = F.array(_number(F.floor(nth / LOW), HIGH), _number(F.pmod(nth, F.lit(LOW)), LOW))
    return (
        F.when(email, _text(moved(_characters(x, F.lit(0), n - kept))))
        .when(secret, _text(moved(_characters(x, F.instr(x, '"'), n - 1, hexadecimal))))
        .when(phone, let(number(F.substring(digits, -10, 10)), lambda d: _digits_in(x, d)))
        .when(ip, F.array_join(F.transform(moved(octets), lambda s: s["x"].cast("string")), "."))
        .when((nth >= 0) & (nth < HIGH * LOW), let(moved(dated), date))
        .when(x.rlike(f"^(?:{CARD})$") & (_luhn(digits) % 10 == 0), let(number(F.substring(digits, F.lit(1), F.char_length(digits) - 1)), card))
        .otherwise(x)
    )


def _rewritten(text: Column, key: Column, undo: bool) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(
        F.zip_with(gaps, F.transform(found, lambda x: _replace(x, key, undo)), lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), ""
    )
    return F.when(text.rlike(HINT), F.when(text.rlike(PATTERN), joined).otherwise(text)).otherwise(text)


def session_key(spark: SparkSession) -> str:
    """The key of the session (KEY_SETTING); an error without one."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to the key of the pseudonyms")
    return key


def _table(spark: SparkSession, name: str, key: str) -> DataFrame:
    """(keys): one row of the keys of the rounds, written at first use and read by its owner only."""
    path = f"{shared_dir(spark)}/scriptorium-keys/{name}"
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm.Path(f"{path}/_SUCCESS")):
        rounds = [hmac.new(key.encode(), f"round {r}".encode(), hashlib.sha256).hexdigest() for r in range(ROUNDS)]
        new = f"{path}.{uuid.uuid4().hex}"
        spark.createDataFrame([(rounds,)], "keys array<string>").coalesce(1).write.parquet(new)
        for file in fs.listStatus(jvm.Path(new)):
            fs.setPermission(file.getPath(), jvm.permission.FsPermission("600"))
        fs.setPermission(jvm.Path(new), jvm.permission.FsPermission("700"))
        if not fs.rename(jvm.Path(new), at) or fs.exists(jvm.Path(f"{path}/{new.rpartition('/')[2]}")):
            fs.delete(jvm.Path(f"{path}/{new.rpartition('/')[2]}"), True)  # another run was first
            fs.delete(jvm.Path(new), True)
    return spark.read.schema("keys array<string>").parquet(path)


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """(keys): the keys of the rounds that belong to `key`."""
    if not key:
        raise ValueError("a key is needed")
    return _table(spark, hashlib.sha256(b"name" + key.encode()).hexdigest()[:32], key)


def stored_keys(spark: SparkSession) -> DataFrame:
    """(keys) of the session's key, or, where none is set, of the random key that the shared folder keeps."""
    key = spark.conf.get(KEY_SETTING, None)
    return key_table(spark, key) if key else _table(spark, "shared", secrets.token_hex(32))


def pseudonymized(text: Column, keys: Column) -> Column:
    """The text with pseudonyms in place of personal data; `keys` are those of the rounds."""
    return _rewritten(text, keys, False)


def restored(text: Column, keys: Column) -> Column:
    """The text before `pseudonymized` with the same keys."""
    return _rewritten(text, keys, True)


def _with_text(docs: DataFrame, keys: DataFrame, rewrite, text_col: str, length_col: str | None) -> DataFrame:
    new, key, was = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}", F.col(length_col or text_col)
    out = docs.withColumn(key, keys.scalar()).withColumn(new, rewrite(F.col(text_col), F.col(key)))
    changed = {text_col: F.col(new)}
    if length_col in docs.columns:
        follows = was == F.char_length(text_col)
        changed[length_col] = F.when(follows, F.char_length(new)).otherwise(was).cast(docs.schema[length_col].dataType)
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def pseudonymize(docs: DataFrame, keys: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with pseudonyms in the text, by a table of keys; a column with its length, if there is one, follows it."""
    return _with_text(docs, keys, pseudonymized, text_col, length_col)


def restore(docs: DataFrame, keys: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` as they were before `pseudonymize` with the same keys."""
    return _with_text(docs, keys, restored, text_col, length_col)
