"""Small text expressions shared by the other function modules."""

import re

from pyspark.sql import Column, functions as F

# The characters that count as surrounding white space.
WHITE_SPACE = " \t\n\x0b\x0c\r\u0085 "


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def blank(c) -> Column:
    """True for NULL and for white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def contains_any(text: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def keep_last_per_key(entries: Column, key: str = "key") -> Column:
    """Array of structs without the entries whose key occurs again later."""
    def is_last(entry, i):
        later = F.slice(entries, i + 2, F.size(entries))
        return ~F.exists(later, lambda other: other[key] == entry[key])
    return F.filter(entries, is_last)


def extract_kv(msg) -> Column:
    """``key=value`` pairs of a log message; the last value of a key wins."""
    msg = col(msg)
    pattern = r"([A-Za-z_][A-Za-z0-9_]*)=(\S+)"
    keys = F.regexp_extract_all(msg, F.lit(pattern), 1)
    values = F.regexp_extract_all(msg, F.lit(pattern), 2)
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.map_from_entries(keep_last_per_key(pairs))


def fuzzy_match(c, query: str) -> Column:
    """True when the characters of ``query`` occur in the text in that order; one pass over the text."""
    pattern = "^" + "".join(f"[^{re.escape(ch)}]*+{re.escape(ch)}" for ch in query)
    return F.lit(True) if query == "" else col(c).rlike(pattern)


def has_end_marker(text) -> Column:
    """The last 256 bytes hold the line a finished dump ends with."""
    tail = F.substring(F.encode(col(text), "UTF-8"), -256, 256)
    return F.contains(tail, F.encode(F.lit("-- Dump completed"), "UTF-8"))


def label_string(job, service, env, region,
                 defaults=("db_backup", "mysql", "pilot")) -> Column:
    """Label list of a host: defaults for blanks, region only where it is set."""
    def quoted(name, value):
        escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit(f'{name}="'), escaped, F.lit('"'))

    def or_default(value, default):
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))

    region = F.nullif(strip(region), F.lit(""))
    return F.concat_ws(
        ",",
        quoted("job", or_default(col(job), defaults[0])),
        quoted("service", or_default(col(service), defaults[1])),
        quoted("env", or_default(strip(env), defaults[2])),
        quoted("region", region),
    )


def object_key(prefix, run_id, rel_path) -> Column:
    """Object-store key ``prefix/run/rel`` with percent-escaped path parts."""
    prefix = F.btrim(strip(prefix), F.lit("/"))
    key = F.concat_ws("/", F.nullif(prefix, F.lit("")), col(run_id).cast("string"), col(rel_path))
    key = F.url_encode(key)
    # url_encode writes form encoding; paths leave these as they are.
    for written, wanted in [("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%24", "$"), ("%26", "&"),
                            ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~")]:
        key = F.replace(key, F.lit(written), F.lit(wanted))
    return key


def staging_name(db) -> Column:
    """Name of the scratch database a copy is restored into, at most 64 characters."""
    db = col(db)
    clean = F.btrim(F.regexp_replace(F.lower(strip(db)), "[^a-z0-9]", "_"), F.lit("_"))
    clean = F.when(F.coalesce(clean, F.lit("")) == "", F.lit("db")).otherwise(clean)
    prefix, digits = "test_restore_", 8
    room = 64 - len(prefix) - 1 - digits
    return F.concat(F.lit(prefix), F.substring(clean, 1, room), F.lit("_"), fnv1a_hex(db))


def fnv1a_hex(text) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, eight hex digits."""
    # Offset basis and prime of 32-bit FNV.
    basis, prime, mask = 2166136261, 16777619, 0xFFFFFFFF
    hexed = F.hex(F.encode(col(text), "UTF-8"))
    starts = F.filter(F.sequence(F.lit(1), F.length(hexed) + 1, F.lit(2)), lambda i: i < F.length(hexed))

    def step(acc, i):
        byte = F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("bigint")
        return (acc.bitwiseXOR(byte) * F.lit(prime).cast("bigint")).bitwiseAND(F.lit(mask).cast("bigint"))

    value = F.aggregate(starts, F.lit(basis).cast("bigint"), step)
    return F.lower(F.lpad(F.hex(value), digits_of(mask), "0"))


def digits_of(mask: int) -> int:
    return len(f"{mask:x}")


def human_bytes(n) -> Column:
    """Size text in powers of 1000, one decimal below ten."""
    n = col(n).cast("bigint")
    out = F.when(n < 10, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(["B", "kB", "MB", "GB", "TB", "PB"]):
        out = out.when(n < 1000 ** (power + 1), _sized(n, power, unit))
    return out.otherwise(_sized(n, 6, "EB"))


def _sized(n, power, unit):
    tenths = F.floor(n / F.lit(float(1000 ** power)) * 10 + 0.5).cast("bigint")
    one_decimal = F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string"))
    whole = F.bround(tenths / F.lit(10.0)).cast("bigint").cast("string")
    return F.concat(F.when(tenths < 100, one_decimal).otherwise(whole), F.lit(" " + unit))


def age_text(seconds) -> Column:
    """``12s ago``, ``5m ago``, ``1.5h ago``."""
    s = F.floor(col(seconds)).cast("bigint")
    tenths = F.floor((s + 180) / 360).cast("bigint")
    hours = F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string"))
    return (F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
            .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
            .otherwise(F.concat(hours, F.lit("h ago"))))
