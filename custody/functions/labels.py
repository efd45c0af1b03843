"""Display labels of coded values and the accepted-value lists."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from custody.functions.text import as_col

# Accepted codes and their display labels.
ASSET_STATUS = {
    "intake": "Intake",
    "testing": "Testing",
    "ready": "Ready for Sale",
    "sold": "Sold",
    "recycled": "Recycled",
    "returned": "Returned to Client",
}
DEVICE_TYPE = {
    "laptop": "Laptop",
    "desktop": "Desktop",
    "server": "Server",
    "tablet": "Tablet",
    "phone": "Phone",
    "other": "Other",
}
COSMETIC_GRADE = {
    "A": "Grade A - Excellent",
    "B": "Grade B - Good",
    "C": "Grade C - Fair",
    "D": "Grade D - Poor",
}
DRIVE_STATUS = {
    "present": "Present",
    "removed": "Removed",
    "removed_before_scan": "Removed Before Scan",
    "wiped": "Wiped",
    "shredded": "Shredded",
    "returned_to_client": "Returned to Client",
}
DRIVE_SOURCE = {
    "lshw": "LSHW Scan",
    "manual": "Manual Entry",
    "spreadsheet": "Spreadsheet Import",
}
TOUCH_TYPE = {
    "view": "Viewed",
    "scan_upload": "Hardware Scan Uploaded",
    "intake_update": "Intake Information Updated",
    "drive_status": "Drive Status Changed",
    "note": "Note Added",
}
EVENT_TYPE = {"REMOVED": "Drive Removed", "SHREDDED": "Drive Shredded"}
DECISION = {"MATCH": "Match", "NO_MATCH": "No Match", "AMBIGUOUS": "Ambiguous"}


def label(code: Column | str, labels: dict[str, str]) -> Column:
    """Label of a code; an unknown code is shown as it is."""
    c = as_col(code)
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(pairs, c), c)
