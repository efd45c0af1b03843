"""Facts read from flattened hardware trees; every one works inside the row.

Unless said otherwise the nodes are taken in stack order (``stack_nodes``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.functions import variants as V
from custody.functions.hashing import json_string, json_text
from custody.functions.serials import plausible_serial, serial_tag, synthetic_serial
from custody.functions.text import as_col, first_non_blank, non_blank, or_blank, strip
from custody.functions.units import (
    clock_text,
    clock_text_ghz,
    format_bytes,
    iec_bytes,
    memory_text,
    memory_text_to_bytes,
)
from custody.operators.tree import first_where, has_class, mentions

# Node classes that may carry the machine's own serial, and the
# words that mark devices.
MACHINE_CLASSES = ["system", "bus", "motherboard", "bridge", "chassis"]
CAMERA_WORDS = ["camera", "webcam", "uvc"]
AUDIO_WORDS = ["audio", "microphone", "sound"]
WIRELESS_WORDS = ["wireless", "wifi", "wlan"]

STACK = "stack_nodes"
DOCUMENT = "nodes"
DASH = "—"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def whole(v: Column) -> Column:
    """A JSON number cut to an integer; texts and absent values give NULL."""
    exact = F.try_variant_get(v, "$", "bigint")
    cut = F.try_variant_get(v, "$", "double").cast("bigint")
    return F.when(V.is_integer(v), exact).when(V.is_number(v), cut)


def whole_or_digits(v: Column) -> Column:
    """A JSON number, or a text made of digits only."""
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(whole(v), F.when(V.is_string(v) & text.rlike("^[0-9]+$"), text).try_cast("bigint"))


def whole_or_text(v: Column) -> Column:
    """A JSON number, or a text that reads as an integer."""
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(whole(v), F.when(V.is_string(v), strip(text)).try_cast("bigint"))


def _name(n: Column) -> Column:
    return first_non_blank(n["product"], n["description"])


def device_serial() -> Column:
    """Root serial, root uuid, then serials (and uuids) of machine-level nodes."""
    root = F.get(F.col(STACK), F.lit(0))

    def own(n: Column) -> Column:
        serial = F.when(has_class(*MACHINE_CLASSES)(n) & plausible_serial(n["serial"]), n["serial"])
        uuid = F.when(has_class("system")(n) & plausible_serial(n["uuid"]), n["uuid"])
        return F.array(serial, uuid)

    in_tree = F.array_compact(F.flatten(F.transform(F.col(STACK), own)))
    return F.coalesce(
        F.when(plausible_serial(root["serial"]), root["serial"]),
        F.when(plausible_serial(root["uuid"]), root["uuid"]),
        F.get(in_tree, F.lit(0)),
    )


def cpu_text() -> Column:
    n = first_where(STACK, lambda n: has_class("processor")(n) & (or_blank(strip(n["product"])) != ""))
    vendor = or_blank(strip(n["vendor"]))
    return F.when(vendor != "", strip(F.concat(n["vendor"], F.lit(" "), n["product"]))).otherwise(
        strip(n["product"])
    )


def system_info() -> Column:
    n = first_where(STACK, has_class("system"))
    return F.when(
        n.isNotNull(),
        F.struct(
            or_blank(n["vendor"]).alias("vendor"),
            or_blank(n["product"]).alias("product"),
            or_blank(n["serial"]).alias("serial"),
        ),
    )


def graphics() -> Column:
    return F.transform(
        F.filter(F.col(STACK), has_class("display")),
        lambda n: F.struct(
            _name(n).alias("product"),
            or_blank(n["vendor"]).alias("vendor"),
            or_blank(n["description"]).alias("description"),
        ),
    )


def network_kind(configuration: Column, description: Column) -> Column:
    """wireless / ethernet / unknown from the settings, then from the description."""
    driver = V.text_at(configuration, "$.driver")
    radio = (
        V.truthy(V.member(configuration, "$.wireless"))
        | V.truthy(V.member(configuration, '$["wireless-info"]'))
        | F.coalesce(driver.contains("wlan"), F.lit(False))
    )
    addressed = V.truthy(V.member(configuration, "$.ip")) | V.truthy(V.member(configuration, "$.ip6"))
    said = _any([F.coalesce(F.lower(description).contains(w), F.lit(False)) for w in WIRELESS_WORDS])
    return F.when(radio | said, "wireless").when(addressed, "ethernet").otherwise("unknown")


def network() -> Column:
    return F.transform(
        F.filter(F.col(STACK), has_class("network")),
        lambda n: F.struct(
            _name(n).alias("product"),
            or_blank(V.text_at(n["logicalname"], "$")).alias("logicalname"),
            or_blank(n["serial"]).alias("mac"),
            network_kind(n["configuration"], n["description"]).alias("type"),
        ),
    )


def multimedia() -> Column:
    names = F.transform(F.filter(F.col(STACK), has_class("multimedia")), lambda n: strip(_name(n)))

    def pick(words: list[str]) -> Column:
        return F.filter(names, lambda t: _any([F.lower(t).contains(w) for w in words]))

    cameras, sounds = pick(CAMERA_WORDS), pick(AUDIO_WORDS)
    return F.struct(
        (F.size(cameras) > 0).alias("webcam"),
        or_blank(F.get(cameras, F.lit(0))).alias("webcam_model"),
        (F.size(sounds) > 0).alias("audio"),
        or_blank(F.get(sounds, F.lit(0))).alias("audio_model"),
    )


def battery() -> Column:
    n = first_where(STACK, lambda n: mentions(n, "id", "battery") | mentions(n, "description", "battery"))
    found = n.isNotNull()
    return F.struct(
        found.alias("present"),
        F.when(found, _name(n)).alias("product"),
        F.when(found, or_blank(n["vendor"])).alias("vendor"),
        F.when(found, whole_or_digits(n["size"])).alias("capacity_bytes"),
    )


def disks() -> Column:
    """Disks with their own serial, or a synthetic one derived from their traits."""

    def disk(n: Column) -> Column:
        stand_in = synthetic_serial(
            json_text(n["logicalname"]), json_string(_name(n)), json_text(n["size"])
        )
        is_text = V.is_string(n["logicalname"])
        return F.struct(
            F.when(plausible_serial(n["serial"]), strip(n["serial"])).otherwise(stand_in).alias("serial"),
            F.when(is_text, V.text_at(n["logicalname"], "$")).otherwise("").alias("logicalname"),
            whole(n["size"]).alias("size_bytes"),
            _name(n).alias("model"),
        )

    return F.transform(F.filter(F.col(STACK), has_class("disk")), disk)


def memory_slots() -> Column:
    def is_bank(n: Column) -> Column:
        bank = F.coalesce(F.lower(n["class"]) == "bank", F.lit(False))
        return bank | mentions(n, "id", "bank") | mentions(n, "description", "bank")

    sized = F.transform(F.filter(F.col(STACK), is_bank), lambda n: F.struct(n.alias("n"), whole(n["size"]).alias("size")))

    def slot(x: Column) -> Column:
        n, size = x["n"], x["size"]
        return F.struct(
            first_non_blank(n["slot"], n["id"], n["description"]).alias("slot"),
            size.alias("size_bytes"),
            F.when(size != 0, format_bytes(size)).alias("size_human"),
            or_blank(n["vendor"]).alias("vendor"),
            or_blank(n["product"]).alias("product"),
            first_non_blank(n["serial"], n["serial_number"]).alias("serial"),
        )

    return F.transform(sized, slot)


def _sized_memory() -> Column:
    return F.filter(F.col(STACK), lambda n: has_class("memory")(n) & V.truthy(n["size"]))


def _total(sizes: Column) -> Column:
    return F.aggregate(F.array_compact(sizes), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def system_memory() -> Column:
    """The last readable size among nodes described as system memory."""
    sizes = F.transform(
        F.filter(_sized_memory(), lambda n: mentions(n, "description", "system memory")),
        lambda n: whole_or_text(n["size"]),
    )
    return F.try_element_at(F.array_compact(sizes), F.lit(-1))


def ram_total() -> Column:
    """System memory, else the sum of all memory that is not cache; 0 when unknown."""
    others = F.transform(
        F.filter(_sized_memory(), lambda n: ~mentions(n, "description", "cache")),
        lambda n: whole_or_text(n["size"]),
    )
    return F.coalesce(F.nullif(system_memory(), F.lit(0).cast("bigint")), _total(others))


def disk_label(d: Column) -> Column:
    size = F.when(d["size_bytes"] != 0, format_bytes(d["size_bytes"]))
    return F.concat_ws(" ", size, non_blank(d["model"]), serial_tag(d["serial"]))


def processor() -> Column:
    """Details of the first processor."""
    n = first_where(STACK, has_class("processor"))
    cfg = n["configuration"]

    def count(name: str) -> Column:
        return strip(V.text_at(cfg, f"$.{name}")).try_cast("bigint")

    max_hz = F.coalesce(whole_or_digits(n["capacity"]), whole_or_digits(n["size"]))
    return F.struct(
        non_blank(strip(n["product"])).alias("model"),
        non_blank(strip(n["vendor"])).alias("vendor"),
        count("cores").alias("cores"),
        count("threads").alias("threads"),
        max_hz.alias("max_hz"),
        clock_text(max_hz).alias("max_hz_human"),
    )


def display_details() -> Column:
    return F.transform(
        F.filter(F.col(STACK), has_class("display")),
        lambda n: F.struct(
            non_blank(strip(_name(n))).alias("product"),
            non_blank(strip(n["vendor"])).alias("vendor"),
            V.text_at(n["configuration"], "$.resolution").alias("resolution"),
            V.text_at(n["configuration"], "$.driver").alias("driver"),
        ),
    )


def adapter_details() -> Column:
    return F.transform(
        F.filter(F.col(STACK), has_class("network")),
        lambda n: F.struct(
            non_blank(strip(_name(n))).alias("product"),
            non_blank(strip(n["vendor"])).alias("vendor"),
            V.text_at(n["logicalname"], "$").alias("logicalname"),
            n["serial"].alias("mac"),
            V.text_at(n["configuration"], "$.driver").alias("driver"),
            V.truthy(V.member(n["configuration"], "$.wireless")).alias("wireless"),
            V.text_at(n["configuration"], "$.ip").alias("ip"),
        ),
    )


def summarise(df: DataFrame) -> DataFrame:
    """Add every per-scan fact to a flattened frame (``tree.flatten``)."""
    facts = df.withColumns(
        {
            "device_serial": device_serial(),
            "cpu_info": cpu_text(),
            "disks": disks(),
            "system_info": system_info(),
            "graphics": graphics(),
            "network": network(),
            "multimedia": multimedia(),
            "battery": battery(),
            "memory_slots": memory_slots(),
            "__ram": ram_total(),
            "__sysmem": system_memory(),
        }
    )
    slot_sizes = F.filter(
        F.transform("memory_slots", lambda s: s["size_bytes"]), lambda x: F.coalesce(x != 0, F.lit(False))
    )
    ram = F.when(F.col("__ram") != 0, format_bytes("__ram"))
    storage = F.when(
        F.size("disks") > 0, F.array_join(F.transform("disks", disk_label), " + ")
    )
    facts = facts.withColumn("hw_summary", F.struct(ram.alias("ram"), storage.alias("storage")))
    total = F.coalesce(
        F.nullif(F.col("__sysmem"), F.lit(0).cast("bigint")),
        F.when(F.size(slot_sizes) > 0, _total(slot_sizes)),
        memory_text_to_bytes(F.col("hw_summary.ram")),
    )
    empty = F.col("hw_summary.ram").isNull() & F.col("hw_summary.storage").isNull()
    return facts.withColumns(
        {
            "memory_total_bytes": total,
            "hw_summary": F.when(~empty, F.col("hw_summary")),
        }
    ).drop("__ram", "__sysmem")


def hardware_card() -> Column:
    """The short card of a machine; first nodes in document order, dashes for gaps."""
    nodes = F.col(DOCUMENT)
    cpu = first_where(nodes, has_class("processor"))
    ram = first_where(
        nodes,
        lambda n: has_class("memory")(n)
        & F.coalesce(F.lower(n["description"]) == "system memory", F.lit(False)),
    )
    gpu = first_where(nodes, has_class("display"))
    nets = F.filter(nodes, has_class("network"))

    def is_radio(n: Column) -> Column:
        named = F.coalesce(V.text_at(n["logicalname"], "$").startswith("wl"), F.lit(False))
        return mentions(n, "product", "wireless") | named

    wifi = first_where(nets, is_radio)
    wired = first_where(
        nets, lambda n: wifi.isNull() | ~F.coalesce(n["path"] == wifi["path"], F.lit(False))
    )
    bolts = F.filter(
        nodes, lambda n: mentions(n, "product", "thunderbolt") | mentions(n, "description", "thunderbolt")
    )
    bolt = F.coalesce(
        first_where(bolts, lambda n: F.coalesce(n["product"].contains("NHI"), F.lit(False))),
        F.get(bolts, F.lit(0)),
    )

    def model(n: Column) -> Column:
        return first_non_blank(n["product"], default=DASH)

    def driver(n: Column) -> Column:
        return first_non_blank(V.text_at(n["configuration"], "$.driver"), default=DASH)

    return F.struct(
        model(cpu).alias("cpu_model"),
        clock_text_ghz(F.try_variant_get(cpu["size"], "$", "string")).alias("cpu_max"),
        V.text_at(cpu["configuration"], "$.microcode").alias("cpu_microcode"),
        iec_bytes(F.try_variant_get(ram["size"], "$", "string")).alias("ram_total"),
        model(gpu).alias("gpu_model"),
        driver(gpu).alias("gpu_driver"),
        model(wifi).alias("wifi_model"),
        driver(wifi).alias("wifi_driver"),
        model(wired).alias("ethernet_model"),
        driver(wired).alias("ethernet_driver"),
        first_non_blank(V.text_at(wired["logicalname"], "$"), default=DASH).alias("ethernet_ifname"),
        first_non_blank(wired["serial"], default=DASH).alias("ethernet_mac"),
        model(bolt).alias("thunderbolt_model"),
        driver(bolt).alias("thunderbolt_driver"),
    )


def is_ephemeral(logicalname: Column | str) -> Column:
    """Card readers, loop devices and optical drives of the live system."""
    short = F.regexp_replace(F.lower(or_blank(as_col(logicalname))), "^/dev/", "")
    return short.startswith("mmc") | short.startswith("loop") | short.startswith("sr")


def hard_drive_present(assets: DataFrame, drives: DataFrame) -> DataFrame:
    """Flag per asset: at least one drive that is not ephemeral."""
    found = drives.groupBy("asset_tag").agg(
        F.bool_or(~is_ephemeral("logicalname")).alias("hard_drive_present")
    )
    return assets.join(found, "asset_tag", "left").na.fill(False, ["hard_drive_present"])


def spec_line(system: Column, cpu: Column, memory_total: Column, drives: Column) -> Column:
    """One-line description: system, processor, memory, first three drives."""
    maker = non_blank(strip(F.concat_ws(" ", non_blank(strip(system["vendor"])), non_blank(strip(system["product"])))))
    cores = F.when(
        (cpu["cores"] != 0) & (cpu["threads"] != 0),
        F.concat(cpu["model"], F.lit(" ("), cpu["cores"].cast("string"), F.lit("C/"),
                 cpu["threads"].cast("string"), F.lit("T)")),
    ).otherwise(cpu["model"])
    labels = F.filter(
        F.transform(
            drives,
            lambda d: strip(F.concat_ws(" ", non_blank(d["size_human"]), non_blank(d["tran"]), non_blank(d["model"]))),
        ),
        lambda t: t != "",
    )
    storage = F.when(
        F.size(labels) > 0,
        F.concat(F.lit("Storage: "), F.array_join(F.slice(labels, 1, 3), " + ")),
    )
    memory = F.concat(F.lit("RAM "), memory_text(memory_total))
    return F.concat_ws(" • ", maker, cores, memory, storage)
