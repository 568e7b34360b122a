"""Scalar rules of the store as column expressions. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
FILE, DIRECTORY, SYMLINK, FIFO, BLOCK, CHAR, SOCKET = 1, 2, 3, 4, 5, 6, 7
TYPE_NAMES = {1: "file", 2: "directory", 3: "symlink", 4: "fifo", 5: "block", 6: "char", 7: "socket"}
TYPE_BITS = {1: 0o100000, 2: 0o040000, 3: 0o120000, 4: 0o010000, 5: 0o060000, 6: 0o020000, 7: 0o140000}
LINEAGE_BITS = 40
ENTRY_WEIGHT = 200
INLINE_MAX = 2048


def _cases(value: Column, of: dict) -> Column:
    out = None
    for k, v in of.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out


def type_name(kind: Column) -> Column:
    """Name of a node type; null of an unknown one."""
    return _cases(kind, TYPE_NAMES)


def type_bits(kind: Column) -> Column:
    """File type bits of a node type, as in a mode word."""
    return _cases(kind, TYPE_BITS)


def lineage_of(inode: Column) -> Column:
    return F.shiftright(inode, LINEAGE_BITS)


def first_inode(lineage: Column) -> Column:
    """The first inode of a lineage; inode 1 is the root."""
    return F.shiftleft(lineage.cast("long"), LINEAGE_BITS) + F.when(lineage == 0, 1).otherwise(0)


def hex_of(b: Column) -> Column:
    return F.lower(F.hex(b))


def parse_hex(text: Column, size: int) -> Column:
    """Bytes of a hex text of exactly ``size`` bytes, else null."""
    return F.when(F.length(text) == 2 * size, F.try_to_binary(text, F.lit("hex")))


def is_hash_name(name: Column) -> Column:
    """At least 32 characters, all lower-case hex."""
    return name.rlike("^[0-9a-f]{32,}$")


def pack_time_ns(name: Column) -> Column:
    """Creation time in a pack name 'p-<16 hex digits of ns>-...', else null. Values beyond a signed long are null."""
    digits = F.regexp_extract(name, "^p-([0-9a-fA-F]{16})-", 1)
    return F.when(digits.rlike("^[0-7]"), F.conv(digits, 16, 10).try_cast("long"))


def valid_ref_name(name: Column) -> Column:
    """Letters, digits, '.', '_' and '-', 1 to 128 long, not starting with '.' or '-'."""
    return name.rlike("^[A-Za-z0-9_][A-Za-z0-9._-]{0,127}$")


def permitted(uid: Column, gid: Column, mode: Column, who: int, groups: tuple[int, ...], want: int, is_dir: Column) -> Column:
    """Whether ``who`` in ``groups`` may do ``want`` (4 read, 2 write, 1 execute) under POSIX mode bits.

    The superuser may read and write all, and execute a directory or what
    anyone may execute. A null owner or group matches nobody.
    """
    bits = F.when(F.coalesce(uid == who, F.lit(False)), F.shiftright(mode, 6)).when(F.coalesce(gid.isin(*groups), F.lit(False)), F.shiftright(mode, 3)).otherwise(mode)
    allowed = bits.bitwiseAND(want) == want
    if who == 0:
        return (F.lit(want & 1 == 0)) | is_dir | (mode.bitwiseAND(0o111) != 0)
    return allowed


def remapped(value: Column, table: dict[int, int]) -> Column:
    """An id through a map of ids; others stay."""
    return F.coalesce(_cases(value, table), value) if table else value


def conflict_name(name: Column, branch: str) -> Column:
    """'stem (from branch).ext': the extension starts at the last dot, unless that is the first character."""
    stem, ext = F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)$", 1), F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)$", 2)
    tail = f" (from {branch})"
    return F.when(stem != "", F.concat(stem, F.lit(tail), ext)).otherwise(F.concat(name, F.lit(tail)))


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def should_merge(child: Column, parent: Column, smax: int, smin: int) -> Column:
    """A child catalog returns to its parent if it is small and both, less the entry that linked them, fit one catalog."""
    return (child < smin) & (child + parent - ENTRY_WEIGHT <= smax)


def worthwhile(packs: Column, age_s: Column, packs_min: int = 200, age_min_s: int = 6 * 3600) -> Column:
    """The reason for or against a repack."""
    return F.when(packs < packs_min, "too few packs").when(age_s < age_min_s, "too soon").otherwise("worthwhile")


def collection_due(repacked: Column, idle: Column, since_s: Column, every_s: int = 6 * 3600) -> Column:
    """Whether to collect now: right after a repack, else at most every six hours while nothing is written."""
    return repacked | (idle & (since_s >= every_s))


def human_bytes(n: Column) -> Column:
    """Bytes with a binary unit and one decimal, whole below 1 KiB."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        scaled = F.format_string("%.1f " + unit, n / float(1 << 10 * i))
        out = out.when(n < 1 << 10 * (i + 1), scaled) if i < 4 else out.otherwise(scaled)
    return out


def parse_size(text: Column) -> Column:
    """'8G', '512m', '100' to bytes; null if malformed."""
    digits, unit = F.regexp_extract(text, r"^(\d{1,12})([kKmMgGtT]?)$", 1), F.lower(F.regexp_extract(text, r"^(\d{1,12})([kKmMgGtT]?)$", 2))
    power = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).when(unit == "t", 1 << 40).otherwise(1)
    return F.when(digits != "", digits.try_cast("long") * power)


def volume_id_text(raw: Column) -> Column:
    """A 16-byte id in the usual 8-4-4-4-12 form."""
    h = hex_of(raw)
    return F.when(F.length(raw) == 16, F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def volume_id_bytes(text: Column) -> Column:
    return parse_hex(F.replace(text, F.lit("-"), F.lit("")), 16)


def live_fraction(live: Column, total: Column) -> Column:
    """Live bytes by bytes; nothing at all counts as fully live."""
    return F.when(total <= 0, 1.0).otherwise(live / total)
