"""Scalar functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension to format id; anything else is `file`.
FORMATS = {"zip": "zip", "jar": "jar", "apk": "apk", "nupkg": "nupkg", "tar": "tar", "gz": "gzip", "zst": "zstd"}
#: Words that mark a setting as secret.
SECRET_WORDS = ("password", "secret", "key", "token")


def normal_path(p: Column) -> Column:
    """Forward slashes, no leading ones."""
    return F.regexp_replace(F.translate(p, "\\", "/"), "^/+", "")


def extension(p: Column) -> Column:
    """Lower-case extension without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(p, r"\.([^./\\]*)$", 1))


def format_id(p: Column) -> Column:
    e = extension(p)
    out = F.lit("file")
    for ext, name in FORMATS.items():
        out = F.when(e == ext, name).otherwise(out)
    return out


def path_tokens(p: Column) -> Column:
    """All segments of a path, empty ones too."""
    return F.split(p, "/", -1)


def strip_component(path: Column, component: Column) -> Column:
    """Path without its component prefix, compared without case; a blank or `default` component strips nothing."""
    p = normal_path(path)
    prefix = F.concat(F.lower(component), F.lit("/"))
    keeps = component.isNull() | (F.trim(component) == "") | (F.lower(component) == "default")
    return F.when(~keeps & F.startswith(F.lower(p), prefix), F.substring(p, F.length(prefix) + 1, F.length(p))).otherwise(p)


def combine_path(component: Column, file: Column) -> Column:
    return F.when(component.isNull() | (component == ""), file).otherwise(F.concat_ws("/", component, file))


def candidate_key(size: Column, revision: Column, path: Column) -> Column:
    return F.lower(F.concat_ws(":", size.cast("string"), revision.cast("string"), path))


def order_key(digest: Column) -> Column:
    """A key under which 32-byte digests sort as four little-endian 64-bit words: the bytes of each word in reverse."""
    order = [8 * word + byte for word in range(4) for byte in range(8, 0, -1)]
    return F.concat(*[F.substring(digest, i, 1) for i in order])


def hash_prefix(digest: Column) -> Column:
    """Bucket of a digest: its first three hexadecimal digits."""
    return F.substring(F.lower(F.hex(digest)), 1, 3)


def url_path(p: Column) -> Column:
    """Each segment of a path encoded for a URL, spaces as %20."""
    return F.array_join(F.transform(F.split(p, "/", -1), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def tenant_slug(host: Column, suffix: str) -> Column:
    """Label in front of the suffix of a host name; null unless there is exactly one."""
    import re

    got = F.regexp_extract(F.lower(host), f"^([a-z0-9-]+)\\.{re.escape(suffix)}(?::[0-9]+)?$", 1)
    return F.when(got != "", got)


def locator_parts(p: Column) -> Column:
    """Container locator `type|archive|entry` as a struct; null if it has not three parts."""
    s = F.split(p, "\\|", 3)
    return F.when(F.size(s) == 3, F.struct(s[0].alias("container"), s[1].alias("archive"), s[2].alias("entry")))


def revision_version(p: Column, strict: bool = False) -> Column:
    """`1.0.N` from a path that ends in -N; otherwise null, or, when strict, an error."""
    n = F.regexp_extract(p, r"-(\d+)/?$", 1)
    none = F.raise_error(F.concat(F.lit("no revision in: "), p)) if strict else F.lit(None).cast("string")
    return F.when(n != "", F.concat(F.lit("1.0."), n)).otherwise(none)


def release_file_name(path: Column, component: Column) -> Column:
    """A path without its first segment when that is the component's name."""
    parts = F.split(path, "/", -1)
    return F.when((F.size(parts) > 1) & (parts[0] == component), F.array_join(F.slice(parts, 2, F.size(parts) - 1), "/")).otherwise(path)


def path_prefixes(path: Column) -> Column:
    """The path itself and all its ancestors, without the empty one."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def masked(name: Column, value: Column) -> Column:
    """A setting's value, or *** if its name marks it as secret and it has one."""
    return F.when(is_secret(name) & (value != ""), "***").otherwise(value)


def natural_key(p: Column) -> Column:
    """A text under which paths sort naturally: digit runs of any length by value (their number of digits in front, leading zeros left
    out), other text without case, fewer parts first."""
    parts = F.regexp_extract_all(p, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def part(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.lower(x))

    return F.array_join(F.transform(parts, part), "\x01")


def bytes_human(n: Column) -> Column:
    """Size in words: two decimals without trailing zeros, units of 1024."""
    units = ["byte", "Kb", "Mb", "Gb", "Tb", "Pb", "Eb"]
    out = None
    for i, u in enumerate(units):
        v = F.round(n / float(1024**i), 2)
        text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", v), "0+$", ""), "\\.$", "")
        text = F.concat(F.regexp_replace(text, "^0\\.", "."), F.lit(" " + u))
        if i == len(units) - 1:
            return F.when(n == 0, "0 Mb").otherwise(out.otherwise(text))
        out = F.when(n < 1024 ** (i + 1), text) if out is None else out.when(n < 1024 ** (i + 1), text)
    return out


def size_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / (1024.0 * 1024)), F.lit(" MB")))


def ratio(n: Column, d: Column, default: float = 1.0) -> Column:
    """n / d, or the default where d is null or not positive."""
    return F.when(d > 0, n / d).otherwise(F.lit(default))


def saved(total: Column, used: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), total - used)


def power_of_two_at_least(n: Column) -> Column:
    """Smallest power of two not below n, at least 1, in whole numbers."""
    bits = F.length(F.bin(F.greatest(n.cast("bigint"), F.lit(1)) - 1))
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits))


def is_secret(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(SECRET_WORDS))


def glob_regex(glob: str) -> str:
    """Anchored pattern of a glob: ** any, * within a folder, ? one character."""
    import re

    g = glob.replace("\\", "/")
    out, i = "", 0
    while i < len(g):
        if g.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + ("[^/]*" if g[i] == "*" else "." if g[i] == "?" else re.escape(g[i])), i + 1
    return f"^{out}$"


def glob_match(path: Column, includes: list[str], excludes: list[str]) -> Column:
    """Kept by globs without regard to case; folders of version control never are.  No includes means all."""
    p = F.translate(path, "\\", "/")
    keep = ~F.lower(p).rlike(r"(^|/)\.(svn|git|hg)/")
    if includes:
        keep = keep & p.rlike("(?i)" + "|".join(glob_regex(g) for g in includes))
    if excludes:
        keep = keep & ~p.rlike("(?i)" + "|".join(glob_regex(g) for g in excludes))
    return keep


def member_selected(path: Column, size: Column, is_dir: Column) -> Column:
    """Members worth extracting: files with a name, not empty, at most 16 MiB."""
    return ~is_dir & (F.trim(path) != "") & (size > 0) & (size <= 16 * 1024 * 1024)


def base64url_text(c: Column) -> Column:
    t = F.translate(c, "-_", "+/")
    return F.decode(F.unbase64(F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4)).cast("int")))), "UTF-8")


def json_or_raw(c: Column) -> Column:
    """Canonical text of valid JSON, the raw text otherwise."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)
