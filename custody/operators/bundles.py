"""Scan bundles: contract check, envelope lift, identity, facts, ingest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.functions import variants as V
from custody.functions.hashing import bundle_hash, document_hash
from custody.functions.serials import tracker_serial
from custody.functions.text import as_col, non_blank, or_blank, strip
from custody.functions.times import parse_iso
from custody.operators import inventory, merge, tools, tree
from custody.operators.bronze import at

# Fixed value: largest accepted document in bytes.
MAX_BYTES = 5_242_880

CONTRACT_ERRORS = [
    "too_large", "not_utf8", "bad_json", "not_an_object", "bad_schema", "no_generated_at",
    "bad_scanner", "bad_intake", "no_lshw", "no_status",
]


def parsed(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``bundle`` (VARIANT, NULL for broken JSON)."""
    return documents.withColumn("bundle", V.parse_document(raw))


def contract_error(
    schema_id: str,
    raw: Column | str = "raw",
    bundle: Column | str = "bundle",
    size: Column | None = None,
    max_bytes: int = MAX_BYTES,
) -> Column:
    """First broken rule of the document contract in checking order, NULL when valid.

    ``schema_id`` is the schema text the collectors write. ``in``-style rules ask
    for presence (a null value counts), the others for a non-blank value.
    """
    text, doc = as_col(raw), as_col(bundle)
    length = size if size is not None else F.octet_length(text)

    def filled(path: str) -> Column:
        return V.truthy(V.member(doc, path))

    def present(path: str) -> Column:
        return V.member(doc, path).isNotNull()

    rules = [
        length > max_bytes,
        ~F.is_valid_utf8(text),
        doc.isNull(),
        ~V.is_object(doc),
        ~F.coalesce(V.text_at(doc, "$.schema") == schema_id, F.lit(False)),
        ~present("$.generated_at"),
        ~(filled("$.scanner.hostname") & filled("$.scanner.user")),
        ~filled("$.intake.asset_id"),
        ~present("$.sources.lshw"),
        ~present("$.meta.status"),
    ]
    return F.coalesce(*[F.when(broken, F.lit(code)) for broken, code in zip(rules, CONTRACT_ERRORS)])


def bundle_asset_id(bundle: Column | str = "bundle") -> Column:
    v = V.member(bundle, "$.intake.asset_id")
    return F.when(V.truthy(v), F.try_variant_get(v, "$", "string")).otherwise(F.lit(""))


def tag_mismatch(tag: Column | str, bundle: Column | str = "bundle", strict: bool = False) -> Column:
    """Bundle is for another asset. A blank id passes unless ``strict`` (bulk loads)."""
    own = bundle_asset_id(bundle)
    differs = own != as_col(tag)
    return differs if strict else differs & (own != "")


def envelope(bundle: Column | str = "bundle") -> dict[str, Column]:
    """Columns lifted from the fixed part of the document."""

    def lifted(path: str) -> Column:
        return or_blank(V.text_at(bundle, path))

    return {
        "schema": lifted("$.schema"),
        "generated_at": parse_iso(V.text_at(bundle, "$.generated_at")),
        "tech_name": lifted("$.intake.tech_name"),
        "client_name": lifted("$.intake.client_name"),
        "cosmetic_condition": lifted("$.intake.cosmetic_condition"),
        "intake_note": lifted("$.intake.note"),
    }


def hardware_tree(bundle: Column | str = "bundle") -> Column:
    """The tree inside the bundle; older scans stored the tree itself."""
    inner = V.member(bundle, "$.sources.lshw")
    return F.when(V.is_object(inner), inner).otherwise(as_col(bundle))


def with_facts(documents: DataFrame) -> DataFrame:
    """Flatten ``sources.lshw`` and add every per-scan fact. No shuffle."""
    flat = tree.flatten(documents, V.member("bundle", "$.sources.lshw"))
    return inventory.summarise(flat)


def rich_summary(documents: DataFrame) -> DataFrame:
    """Wide per-scan summary from all collectors; expects ``with_facts`` output."""

    def source(name: str) -> Column:
        v = V.member("bundle", f"$.sources.{name}")
        return F.when(V.is_string(v), F.try_variant_get(v, "$", "string"))

    step = documents.withColumns(
        {
            "cpu": inventory.processor(),
            "displays": inventory.display_details(),
            "adapters": inventory.adapter_details(),
            "power": tools.power_fields(source("upower")),
            "panel": tools.panel_fields(source("edid"))["summary"],
            "__smart": tools.smart_fields(source("smart")),
        }
    )
    step = step.withColumn(
        "drives", tools.enriched_disks(V.member("bundle", "$.sources.lsblk"), F.col("__smart"))
    )
    return step.withColumn(
        "spec_line",
        inventory.spec_line(
            F.col("system_info"), F.col("cpu"), F.col("memory_total_bytes"), F.col("drives")
        ),
    ).drop("__smart")


def card(documents: DataFrame) -> DataFrame:
    """The compact machine card; expects flattened documents."""

    def source(name: str) -> Column:
        v = V.member("bundle", f"$.sources.{name}")
        return or_blank(F.when(V.is_string(v), F.try_variant_get(v, "$", "string")))

    def shown(path: str) -> Column:
        return F.coalesce(non_blank(V.text_at("bundle", path)), F.lit("—"))

    return documents.withColumns(
        {
            "hw": inventory.hardware_card(),
            "hw_display": tools.panel_fields(source("edid")),
            "hw_battery": tools.battery_card(source("upower")),
            "hw_drives": tools.block_disks(V.member("bundle", "$.sources.lsblk")),
            "hw_usb": tools.usb_devices(source("lsusb")),
            "hw_smart": tools.smart_hint(source("smart")),
            "hw_generated_at": shown("$.generated_at"),
            "hw_scanner": F.concat(
                F.coalesce(V.text_at("bundle", "$.scanner.hostname"), F.lit("—")), F.lit(" / "),
                F.coalesce(V.text_at("bundle", "$.scanner.user"), F.lit("—")),
            ),
            "hw_health": tools.scan_health(V.member("bundle", "$.meta.status")),
        }
    )


def scan_drives(facts: DataFrame, order: list[str]) -> DataFrame:
    """Latest facts per (asset, disk serial); within a scan the later disk wins."""
    # Outer form: an inferred size filter would be pushed below the flattening.
    rows = facts.select(
        "asset_tag", *order, F.posexplode_outer("disks").alias("__pos", "d")
    ).filter(strip(F.col("d.serial")) != "")
    return (
        rows.groupBy("asset_tag", F.col("d.serial").alias("serial"))
        .agg(F.max_by("d", F.struct(*order, "__pos")).alias("d"))
        .select(
            "asset_tag", "serial",
            F.col("d.logicalname").alias("logicalname"),
            F.col("d.size_bytes").alias("capacity_bytes"),
            F.col("d.model").alias("model"),
            F.lit("lshw").alias("source"),
            F.lit("present").alias("status"),
        )
    )


def upsert_drives(stored: DataFrame, changes: DataFrame, run_ts: datetime | Column) -> DataFrame:
    """Refresh the description of known drives, add new ones as present; status stays."""
    stamped = changes.withColumns(
        {"status_note": F.lit(""), "status_at": at(run_ts)}
    )
    return merge.upsert(
        stored, stamped, ["asset_tag", "serial"],
        {
            "logicalname": merge.replace,
            "capacity_bytes": merge.replace,
            "model": merge.replace,
            "source": merge.replace,
            "status": merge.keep,
            "status_note": merge.keep,
            "status_at": merge.replace,
        },
    )


def judged(
    documents: DataFrame, schema_id: str | None = None, bulk: bool = False, hash_mode: str = "canonical"
) -> DataFrame:
    """Add ``bundle``, ``bundle_hash`` and ``error`` to documents of (asset_tag, file_name, raw). No shuffle.

    Both columns are costly, and a filter on one is pushed below the parsing, where every
    mention of the document parses it again: a plan that goes on with them stages them first.
    """
    docs = parsed(documents)
    checks = [F.when(F.col("asset_tag").isNull(), F.lit("bad_file_name"))]
    if schema_id is not None:
        checks.append(contract_error(schema_id))
    checks += [
        F.when(F.col("bundle").isNull(), F.lit("bad_json")),
        F.when(~V.is_object(F.col("bundle")), F.lit("not_an_object")),
        F.when(tag_mismatch("asset_tag", strict=bulk), F.lit("asset_mismatch")),
    ]
    identity = document_hash("bundle") if hash_mode == "canonical" else bundle_hash("raw", hash_mode)
    return docs.withColumns({"bundle_hash": identity, "error": F.coalesce(*checks)})


def file_key(docs: DataFrame) -> list[str]:
    """Columns that tell the files of a load apart."""
    return ["asset_tag", "bundle_hash", "file_name", *(c for c in ["path"] if c in docs.columns)]


def winners(docs: DataFrame, stored_scans: DataFrame) -> DataFrame:
    """``file_key`` of the judged documents to be stored: the first file of each content not stored yet."""
    key, place = ["asset_tag", "bundle_hash"], file_key(docs)[2:]
    # The error is asked inside the aggregate and the hash is never null here: no filter to push below the parsing.
    first = F.min(F.when(F.col("error").isNull(), F.struct(*place))).alias("__first")
    firsts = docs.select("asset_tag", F.coalesce("bundle_hash", F.lit("")).alias("bundle_hash"), "error", *place).groupBy(*key).agg(first)
    return (
        firsts.where("__first IS NOT NULL").select(*key, "__first.*")
        .join(stored_scans.select(*key), key, "left_anti")
    )


def decided(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Add ``outcome`` to judged documents, given the ``winners`` among them."""
    marked = docs.join(new.withColumn("__new", F.lit(True)), file_key(docs), "left")
    return marked.withColumn(
        "outcome",
        F.when(F.col("error").isNotNull(), "failed").when(F.col("__new"), "created").otherwise("duplicate"),
    ).drop("__new")


def classify(
    documents: DataFrame,
    stored_scans: DataFrame,
    schema_id: str | None = None,
    bulk: bool = False,
    hash_mode: str = "canonical",
) -> DataFrame:
    """Add ``bundle``, ``bundle_hash``, ``error`` and ``outcome`` to documents.

    ``documents`` has (asset_tag, file_name, raw); ``asset_tag`` NULL marks a bad file
    name. ``schema_id`` switches the contract check on (single uploads make it,
    bulk uploads do not). Outcomes: created, duplicate, failed. Of equal documents of a
    load the one of the smallest file name, then path, is created; without a ``path``
    column equal names are one file listed more than once.
    """
    docs = judged(documents, schema_id, bulk, hash_mode)
    return decided(docs, winners(docs, stored_scans))


LOAD_ORDER = ["generated_at", "bundle_hash"]


def scan_rows(
    created: DataFrame,
    run_ts: datetime | Column,
    user: str,
    notes: Column | None = None,
) -> DataFrame:
    """Scan rows to append for newly created documents, with their disks. No shuffle."""
    return with_facts(created).select(
        "asset_tag", "bundle_hash",
        *[c.alias(name) for name, c in envelope().items()],
        "device_serial",
        F.col("hw_summary").alias("summary"),
        at(run_ts).alias("scanned_at"),
        F.lit(user).alias("scanned_by"),
        (notes if notes is not None else F.lit("")).alias("user_notes"),
        "disks", "raw",
    )


def asset_changes(accepted: DataFrame, scans: DataFrame, run_ts: datetime | Column, user: str) -> DataFrame:
    """One row per asset of a load, with the first machine serial its scans name.

    Every accepted document creates its asset on first sight, duplicates too.
    """
    serials = (
        scans.select("asset_tag", *LOAD_ORDER, tracker_serial("device_serial").alias("s"))
        .filter("s <> ''")
        .groupBy("asset_tag")
        .agg(F.min_by("s", F.struct(*LOAD_ORDER)).alias("computer_serial"))
    )
    return (
        accepted.select("asset_tag").distinct().join(serials, "asset_tag", "left")
        .withColumns({"created_at": at(run_ts), "created_by": F.lit(user)})
    )


def upsert_assets(assets: DataFrame, changes: DataFrame) -> DataFrame:
    """Create unknown assets; fill the computer serial only where it is blank."""
    blank = ["status", "device_type", "cosmetic_grade", "cosmetic_notes", "location"]
    policies = {c: merge.initial("") for c in blank if c in assets.columns}

    def fill_serial(old, new, stored, incoming):
        return F.when(tracker_serial(old) != "", old).otherwise(F.coalesce(non_blank(new), old))

    return merge.upsert(
        assets, changes, ["asset_tag"],
        {**policies, "computer_serial": fill_serial, "created_at": merge.keep, "created_by": merge.keep},
    )


def bulk_summary(outcomes: DataFrame, assets_before: DataFrame) -> DataFrame:
    """One row of totals for a bulk load, with asset counts by first sight.

    As in the source system every accepted file after an asset's first counts as
    an update of that asset.
    """
    good = F.col("outcome") != "failed"
    per_tag = outcomes.groupBy("asset_tag").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("accepted"),
        F.count_if(F.col("outcome") == "created").alias("created_scans"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(~good).alias("failed"),
    )
    known = assets_before.select("asset_tag", F.lit(True).alias("__known"))
    fresh = (F.col("accepted") > 0) & F.col("__known").isNull()
    return (
        per_tag.join(known, "asset_tag", "left")
        .withColumn("created_assets", F.when(fresh, 1).otherwise(0))
        .agg(
            *[
                F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                for c in ["total", "created_assets"]
            ],
            F.coalesce(F.sum(F.col("accepted") - F.col("created_assets")), F.lit(0))
            .cast("bigint").alias("updated_assets"),
            *[
                F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                for c in ["created_scans", "duplicates", "failed"]
            ],
        )
    )


def first_errors(outcomes: DataFrame, n: int = 5) -> DataFrame:
    """Preview of the failed files."""
    return (
        outcomes.filter(F.col("outcome") == "failed")
        .select("file_name", "asset_tag", "error")
        .orderBy("file_name")
        .limit(n)
    )
