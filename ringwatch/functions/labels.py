"""Readable names and values of snapshot columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringwatch import constants as K


def base_feature(feature: Column) -> Column:
    return F.split(feature, "__").getItem(0)


def human_label(feature: Column, labels: dict[str, str] | None = None, hinted: list[str] | None = None) -> Column:
    labels = K.COLUMN_LABELS if labels is None else labels
    hinted = K.SNAPSHOT_HINTED if hinted is None else hinted
    base = base_feature(feature)
    listed = base.isin(hinted) if hinted else F.lit(False)
    known = F.lit(None).cast("string")
    for name, text in labels.items():
        known = F.when(base == name, text).otherwise(known)
    badge = F.when(listed, " [bank-listed feature]").otherwise("")
    flag_badge = F.when(listed, " [bank-listed]").otherwise("")
    blank = F.concat(F.lit("whether '"), base, F.lit("'"), flag_badge, F.lit(" profile field is blank"))
    named = F.concat(known, F.lit(" ("), base, F.lit(")"), badge)
    plain = F.concat(F.lit("behavioral indicator "), base, F.lit(" (anonymized)"), badge)
    return F.when(feature.endswith(K.FLAG_SUFFIX), blank).otherwise(F.coalesce(named, plain))


def readable_value(feature: Column, value: Column, tenure: str = "F3889", binary: str = "F670") -> Column:
    """Value text for an analyst; the value column is text, null means blank."""
    base = base_feature(feature)
    number = value.try_cast("double")
    text = F.lit(None).cast("string")
    for code, label in K.TENURE_LABELS.items():
        text = F.when(value == code, label).otherwise(text)
    shown = F.when(F.abs(number) >= 1, F.format_number(number, 2)).otherwise(F.format_number(number, 4))
    return (
        F.when(feature.endswith(K.FLAG_SUFFIX), F.when(number == 1, "BLANK").otherwise("present"))
        .when(value.isNull(), "BLANK")
        .when((base == tenure) & text.isNotNull(), text)
        .when(base == binary, F.when(number == 1, "set (1)").otherwise("not set (0)"))
        .otherwise(F.coalesce(shown, value))
    )
