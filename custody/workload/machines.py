"""Orders seen as scanned machines: one hardware tree and one scan bundle per order.

Every part of a tree follows from the order key, so SQL can say what each
extractor must find without walking a tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custody.session import spread

SCHEMA_ID = "intake.scan_bundle.v1"

_K = "o_orderkey"


def _obj(*members: str) -> str:
    """SQL text building one JSON object; a NULL member is left out."""
    return f"concat('{{', concat_ws(',', {', '.join(members)}), '}}')"


def _text(name: str, value: str) -> str:
    return f"concat('\"{name}\":\"', {value}, '\"')"


def _raw(name: str, value: str) -> str:
    return f"concat('\"{name}\":', {value})"


def _when(condition: str, member: str) -> str:
    return f"CASE WHEN {condition} THEN {member} END"


def _children(*parts: str) -> str:
    return f"concat('\"children\":[', concat_ws(',', {', '.join(parts)}), ']')"


def _several(limit: str, body: str) -> str:
    """Comma-joined objects for i = 1 .. limit (limit at most 3), NULL for none."""
    return (
        f"nullif(array_join(transform(filter(sequence(1, 3), i -> i <= {limit}), i -> {body}), ','), '')"
    )


_BANK = _obj(
    "concat('\"id\":\"bank:', i - 1, '\"')", "'\"class\":\"memory\",\"description\":\"DIMM\"'",
    _text("slot", "concat('Slot ', i)"),
    _when(f"{_K} % 6 <> 3", _raw("size", "i * 1073741824L")),
    "'\"vendor\":\"MV\"'", _text("product", "concat('MP', i)"),
    _text("serial-number", f"concat('SN1-', {_K})"),
    _when("i > 1", _text("serial", f"concat('MS', i, '-', {_K})")),
)
_MEMORY = _obj(
    "'\"id\":\"memory\",\"class\":\"memory\"'",
    _text("description", f"CASE WHEN {_K} % 3 <> 0 THEN 'System Memory' ELSE 'Memory module set' END"),
    _when(f"{_K} % 3 <> 0", _raw("size", f"({_K} % 4 + 1) * 4294967296L")),
    _when(f"{_K} % 6 = 3", "'\"size\":\"2147483648\"'"),
    _children(_several(f"{_K} % 4", _BANK)),
)
_CPU_0 = _obj(
    "'\"id\":\"cpu:0\",\"class\":\"processor\",\"vendor\":\"CV\",\"size\":2400000000'",
    _text("product", f"concat('CPU A', {_K} % 17)"),
    _when(f"{_K} % 4 = 1", "'\"capacity\":\"3600000000\"'"),
    _when(f"{_K} % 4 = 3", "'\"capacity\":3700000000'"),
    f"concat('\"configuration\":{{\"cores\":\"4\",\"threads\":\"8\",\"microcode\":\"m', {_K} % 3, '\"}}')",
)
_CPU_1 = _obj(
    "'\"id\":\"cpu:1\",\"class\":\"processor\",\"size\":900000000'",
    _text("product", f"concat('CPU B', {_K} % 17)"),
    "'\"configuration\":{\"cores\":2,\"threads\":\"many\"}'",
)
_DISPLAY = _obj(
    "concat('\"id\":\"display:', i, '\",\"class\":\"display\",\"vendor\":\"GV\"')",
    _when("i = 1", "'\"product\":\"GPU 1\"'"),
    _text("description", "concat('VGA controller ', i)"),
    "concat('\"configuration\":{\"driver\":\"drv', i, '\",\"resolution\":\"1920,1080\"}')",
)
_ETHERNET = _obj(
    "'\"id\":\"network:0\",\"class\":\"network\",\"product\":\"Eth NIC\",\"logicalname\":\"eth0\"'",
    _text("serial", f"concat('02:00:', {_K} % 90 + 10)"),
    "'\"description\":\"Ethernet interface\"'",
    f"concat('\"configuration\":{{\"driver\":\"e1000\",\"ip\":\"10.0.0.', {_K} % 250, '\"}}')",
)
_WIFI = _obj(
    "'\"id\":\"network:1\",\"class\":\"network\",\"logicalname\":\"wlp1s0\",\"description\":\"Wireless interface\"'",
    _text("product", f"concat('Wireless AC ', {_K} % 5)"),
    "'\"configuration\":{\"wireless\":\"IEEE 802.11\",\"driver\":\"iwl\"}'",
)
_CAMERA = _obj("'\"id\":\"cam\",\"class\":\"multimedia\"'", _text("product", f"concat('UVC Camera ', {_K} % 3)"))
_SOUND = _obj("'\"id\":\"sound\",\"class\":\"multimedia\"'", _text("description", f"concat('Audio device ', {_K} % 4)"))
_BOLT = "'{\"id\":\"tb\",\"class\":\"bridge\",\"product\":\"Thunderbolt Bridge\"}'"
_BOLT_NHI = (
    "'{\"id\":\"tb2\",\"class\":\"bridge\",\"product\":\"Thunderbolt NHI\",\"configuration\":{\"driver\":\"tbolt\"}}'"
)
_DISK = _obj(
    "concat('\"id\":\"disk:', i, '\",\"class\":\"disk\"')",
    _text("product", f"concat('Disk ', ({_K} + i) % 23)"),
    _text("logicalname", "concat('/dev/sd', i)"),
    _when("i < 3", _raw("size", f"i * 1000000000L * ({_K} % 9 + 1)")),
    _text("serial", f"CASE WHEN i = 2 THEN 'none' ELSE concat(' D', lpad({_K}, 8, '0'), '-', i, ' ') END"),
)
_STORAGE = _obj("'\"id\":\"storage\",\"class\":\"storage\"'", _children(_several(f"{_K} % 4", _DISK)))
_PCI = _obj(
    "'\"id\":\"pci\",\"class\":\"bridge\"'", _text("serial", f"concat('BRG', lpad({_K}, 8, '0'))"),
    _children(
        _several(f"{_K} % 3", _DISPLAY), _ETHERNET, _when(f"{_K} % 2 = 1", _WIFI),
        _when(f"{_K} % 5 = 1", _CAMERA), _SOUND,
        _when(f"{_K} % 7 = 0", _BOLT), _when(f"{_K} % 14 = 0", _BOLT_NHI), _STORAGE,
    ),
)
_BATTERY = _obj(
    "'\"id\":\"battery\",\"class\":\"power\",\"description\":\"Lithium Battery\",\"vendor\":\"BV\"'",
    _text("size", f"{_K} % 50 * 1000"),
)
_CORE = _obj(
    "'\"id\":\"core\",\"class\":\"bus\"'",
    _when(f"{_K} % 20 <> 0", _text("serial", f"concat('BUS', lpad({_K}, 8, '0'))")),
    _children(
        _MEMORY,
        "'{\"id\":\"cache\",\"class\":\"memory\",\"description\":\"L1 cache\",\"size\":262144}'",
        _CPU_0, _when(f"{_K} % 2 = 0", _CPU_1), _PCI, _when(f"{_K} % 4 = 0", _BATTERY),
    ),
)
TREE = _obj(
    _text("id", f"concat('m', {_K})"), "'\"class\":\"system\"'",
    _text("vendor", f"concat('V', {_K} % 7)"), _text("product", f"concat('Model ', {_K} % 9)"),
    _text("serial", f"CASE WHEN {_K} % 5 = 0 THEN 'unknown' ELSE concat('SYS', lpad({_K}, 8, '0')) END"),
    _when(f"{_K} % 10 <> 0", _text("uuid", f"concat('UUID-', lpad({_K}, 8, '0'))")),
    _children(_CORE),
)

_NVME = _obj(
    "'\"name\":\"nvme0n1\",\"path\":\"/dev/nvme0n1\",\"type\":\"disk\",\"tran\":\"nvme\",\"rm\":false'",
    _raw("size", f"({_K} % 9 + 1) * 1000000000L"),
    _raw("model", f"CASE WHEN {_K} % 3 = 0 THEN 'null' ELSE concat('\"NV', {_K} % 5, '\"') END"),
    _raw("serial", f"CASE WHEN {_K} % 4 = 0 THEN 'null' ELSE concat('\"S', {_K}, '\"') END"),
    _text("wwn", f"concat('w', {_K})"),
    "'\"children\":[{\"name\":\"p1\",\"type\":\"part\",\"fstype\":\"ext4\",\"size\":\"2048\",\"mountpoint\":\"/\",'",
    f"concat('\"fsuse%\":\"', {_K} % 100, '%\"}},{{\"name\":\"vg\",\"type\":\"lvm\"}},{{\"name\":\"p2\",\"type\":\"part\",\"size\":512}}]')",
).replace("\"mountpoint\":\"/\",'", "\"mountpoint\":\"/\"'")
LSBLK = (
    "concat('{\"blockdevices\":[', concat_ws(',', " + _NVME + ", "
    "'{\"name\":\"sdb\",\"type\":\"disk\",\"tran\":\"usb\",\"rm\":true,\"size\":5}',"
    "'{\"name\":\"sdc\",\"path\":\"/dev/sdc\",\"type\":\"disk\",\"tran\":\"SATA\",\"rm\":true,\"size\":100,\"model\":\"HotSwap\",\"serial\":\"HS\"}',"
    "'{\"name\":\"sdd\",\"type\":\"disk\",\"rm\":true,\"size\":7}',"
    "'{\"name\":\"loop0\",\"type\":\"disk\",\"rm\":false}', '{\"name\":\"sr0\",\"type\":\"rom\"}', '7',"
    f"CASE WHEN {_K} % 2 = 0 THEN '{{\"name\":\"sde\",\"type\":\"disk\",\"tran\":null,\"rm\":false}}' END), ']}}')"
)
_SMART = (
    f"concat('\"smart\":\"Device Model:     SM', {_K}, '\\\\nSerial Number:    SS', {_K},"
    " '\\\\nUser Capacity:    5,120 bytes [x]\\\\nSMART overall-health test result: PASSED\\\\n\"')"
)
_SOURCES = _obj(
    _raw("lshw", TREE), _raw("lsblk", LSBLK), _SMART,
    f"concat('\"lsusb\":\"Bus 001 Linux Foundation hub\\\\n\\\\n Bus 002 Device ', {_K} % 40, '\\\\n\"')",
    "'\"edid\":null'",
)
_STATUS = (
    f"concat('\"meta\":{{\"status\":{{\"lshw\":{{\"rc\":0,\"stderr\":\"\"}},\"smart\":{{\"rc\":', {_K} % 3,"
    " ',\"stderr\":\" first\\\\nsecond\"}}}')"
)
BUNDLE = _obj(
    f"'\"schema\":\"{SCHEMA_ID}\"'",
    _text("generated_at", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"),
    f"concat('\"scanner\":{{\"hostname\":\"h', {_K} % 5, '\",\"user\":\"u\"}}')",
    f"concat('\"intake\":{{\"asset_id\":\"A', o_custkey, '\",\"tech_name\":\"T', {_K} % 4, '\",\"note\":null}}')",
    _raw("sources", _SOURCES), _STATUS,
)


def machines(t) -> DataFrame:
    return spread(t.orders.select(_K, "o_custkey", "o_orderdate"))


def trees(t) -> DataFrame:
    """(scan_id, tree) per order."""
    return machines(t).select(F.col(_K).alias("scan_id"), F.try_parse_json(F.expr(TREE)).alias("tree"))


def documents(t) -> DataFrame:
    """(scan_id, asset_tag, file_name, raw) per order; the asset is the customer."""
    return machines(t).select(
        F.col(_K).alias("scan_id"),
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("asset_tag"),
        F.concat(F.col(_K).cast("string"), F.lit(".json")).alias("file_name"),
        F.expr(BUNDLE).alias("raw"),
    )


# What SQL knows about machine k.
SQL_MACHINE = """
    m AS (SELECT o_orderkey AS k, o_orderkey AS scan_id, o_custkey, o_orderdate, lpad(o_orderkey::VARCHAR, 8, '0') AS kk,
                 o_orderkey % 4 AS n4, o_orderkey % 3 AS n3,
                 CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 4 + 1) * 4294967296
                      WHEN o_orderkey % 6 = 3 THEN 2147483648
                      WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4) * (o_orderkey % 4 + 1) // 2 * 1073741824 END AS mem
          FROM orders),
    i3 AS (SELECT * FROM (VALUES (1), (2), (3)) v(i)),
    disk AS (SELECT k, i, '/dev/sd' || i AS logicalname, 'Disk ' || ((k + i) % 23) AS model,
                    CASE WHEN i < 3 THEN i * 1000000000 * (k % 9 + 1) END AS size_bytes,
                    CASE WHEN i = 2 THEN 'NOSERIAL-' || substr(sha1('{"logical": "/dev/sd2", "model": "Disk ' || ((k + 2) % 23)
                         || '", "size": ' || (2000000000 * (k % 9 + 1)) || '}'), 1, 12)
                         ELSE 'D' || kk || '-' || i END AS serial
             FROM m, i3 WHERE i <= n4),
    disk_text AS (SELECT *, CASE WHEN size_bytes IS NULL THEN '' ELSE CASE WHEN size_bytes < 1073741824 THEN printf('%.1f MB ', size_bytes / 1048576) ELSE printf('%.1f GB ', size_bytes / 1073741824) END END AS size_text FROM disk)
"""

# The storage label of machine m.
SQL_STORAGE = """
    (SELECT string_agg(size_text || model || CASE WHEN i = 2 THEN ' (no serial)' ELSE ' (SN ' || serial || ')' END, ' + ' ORDER BY i DESC)
     FROM disk_text WHERE disk_text.k = m.k)
"""
