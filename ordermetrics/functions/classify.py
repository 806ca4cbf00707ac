"""Rule-based labels.

A rule list is an ordered list of ``(condition, label)``; :func:`first_match`
folds it to one CASE so that every label costs a single projection inside the
scan's codegen stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.functions import vocabulary as V
from ordermetrics.functions.predicates import as_column, in_list, mentions, moment
from ordermetrics.functions.vocabulary import Vocabulary
from ordermetrics.operators.rules import MISSING

Rules = Sequence[tuple[Column, object]]


def _label(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def first_match(rules: Rules, default=None) -> Column:
    """Label of the first rule that holds."""
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, _label(label))
    return chain.otherwise(_label(default))


def last_match(rules: Rules, default=None) -> Column:
    """Label of the last rule that holds (later rules overwrite earlier ones)."""
    return first_match(list(reversed(list(rules))), default)


def code_label(column: Column | str, labels: Mapping[str, str], default=None) -> Column:
    """Display name of a code."""
    column = as_column(column)
    return first_match([(column == F.lit(code), name) for code, name in labels.items()], default)


def relabel(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename report columns to their display names."""
    return df.withColumnsRenamed(dict(names))


# --- kit and upgrade ------------------------------------------------------

def kit_type(prescription_id: Column | str = "prescription_id", single="singlekit", multi="multikit") -> Column:
    return F.when(as_column(prescription_id).isNull(), F.lit(single)).otherwise(F.lit(multi))


def is_upgrade(meta: Column | str = "order_meta_values", *, vocab: Vocabulary) -> Column:
    return mentions(meta, *vocab.upgrade_phrases)


def upgrade_type(meta: Column | str = "order_meta_values",
                 yes="upgrade", no="nonupgrade", *, vocab: Vocabulary) -> Column:
    return F.when(is_upgrade(meta, vocab=vocab), F.lit(yes)).otherwise(F.lit(no))


def kit_upgrade_status(meta: Column | str = "order_meta_values", prescription_id: Column | str = "prescription_id", *, vocab: Vocabulary) -> Column:
    """Upgrade wins over kit type."""
    return first_match(
        [(is_upgrade(meta, vocab=vocab), "Upgrade"), (as_column(prescription_id).isNotNull(), "Multi Kit")], "Single Kit"
    )


def upgrade_detail(meta: Column | str = "order_meta_values", *, vocab: Vocabulary) -> Column:
    """Which version was left; the version may stand anywhere after the phrase."""
    low = F.lower(as_column(meta))
    left, starter = vocab.upgrade_phrases
    steps = [(low.like(f"%{left} %v{n}%"), f"V{n} to V{n + 1} Upgrade") for n in (1, 2, 3, 4)]
    return first_match(
        [*steps, (low.contains(starter), "Exp to Clinical Upgrade"), (low.contains(left), "Other Upgrade")],
        "Nonupgrade",
    )


def canonical_order_id(prescription_id: Column | str = "prescription_id", order_id: Column | str = "order_id") -> Column:
    """One id per first kit: all kits of a prescription share it."""
    return F.coalesce(as_column(prescription_id), as_column(order_id))


# --- order labels ---------------------------------------------------------

def order_channel(flow: Column | str = "order_flow", *, vocab: Vocabulary) -> Column:
    flow = as_column(flow)
    return first_match(
        [
            (flow.isNull() | in_list(flow, vocab.patient_flows), "Patient Initiated"),
            (in_list(flow, V.UNINSURED_FLOWS), "No Insurance"),
            (in_list(flow, V.DOCTOR_FLOWS), "Doctor Initiated"),
        ],
        "Channel Undefined",
    )


def sample_status(state: Column | str = "state", meta: Column | str = "order_meta_values", *, vocab: Vocabulary) -> Column:
    """Closed states first, then the metadata override, then open states."""
    state = as_column(state)
    return first_match(
        [
            (in_list(state, vocab.rejected_states), "Order Rejected"),
            (in_list(state, V.CANCELLED_STATES), "Order Cancelled"),
            (state == "DRAFT", "Legacy Draft Orders"),
            (mentions(meta, "sample received") | in_list(state, V.RETURNED_STATES), "Sample Received"),
            (in_list(state, V.OPEN_STATES + V.PENDING_STATES), "Sample Not Returned"),
        ],
        "Case Undefined",
    )


def pending_items(state: Column | str = "state") -> Column:
    return F.when(in_list(state, V.PENDING_STATES), F.lit("Orders Pending Action Items")).otherwise(
        F.lit("No Pending Items")
    )


def order_funnel(state: Column | str = "state", billed: Column | str = "billed",
                 meta: Column | str = "order_meta_values", delivery_id: Column | str = "delivery_id",
                 prescription_id: Column | str = "prescription_id", *, vocab: Vocabulary) -> Column:
    """Furthest stage an order reached."""
    state = as_column(state)
    dropped = vocab.rejected_states + V.CANCELLED_STATES + ["DRAFT"]
    return first_match(
        [
            (in_list(state, dropped), "Misc."),
            (F.coalesce(as_column(billed), F.lit(False)), "6. Orders that are billed"),
            (mentions(meta, "sample received") | in_list(state, V.RETURNED_STATES), "5. Orders that received Samples"),
            (as_column(delivery_id).isNotNull(), "4. Orders that shipped Kits"),
            (in_list(state, V.PENDING_STATES), "3. Orders Pending Action Items"),
            (as_column(prescription_id).isNotNull() & (state == "APPROVED"), "2. Orders in Multikit in Queue"),
        ],
        "1. Orders",
    )


BACKEND, BACKEND_SHORT = "Other Backend Generated Orders (VIP, NTRF, etc)", "Other Backend Generated Orders (VIP, NTRF)"


def utm_filled(source: Column | str = "utm_source", medium: Column | str = "utm_medium",
               meta: Column | str = "order_meta_values", flow: Column | str = "order_flow",
               created_at: Column | str = "created_at", recent: bool = False, *, vocab: Vocabulary) -> Column:
    """Traffic source, inferred where none was tracked.

    ``recent`` selects the last-24-hours wording: a shorter backend label for
    two of its phrases, and only ``facebook`` itself counts as facebook.
    """
    source, medium = as_column(source), as_column(medium)
    facebook = ["facebook"] if recent else ["facebook", "facebook.com"]
    inferred = first_match(
        [
            (as_column(created_at) < moment(vocab.utm_start), "Before UTM Integration"),
            (medium.isNotNull(), medium),
            (is_upgrade(meta, vocab=vocab), "Upgrades with no UTM"),
            (mentions(meta, "vip", "ntrf"), BACKEND_SHORT if recent else BACKEND),
            (F.lower(as_column(meta)).like("%recollected_from%"), BACKEND),
            (F.lower(as_column(meta)).like("%kit_barcode_replaced%"), BACKEND),
            (in_list(flow, V.DOCTOR_FLOWS), "HCP initiated orders with no UTM"),
        ],
        "No UTM Source",
    )
    return first_match(
        [(source.isNull(), inferred), (source == "google", "google"), (in_list(source, facebook), "facebook")], medium
    )


# --- marketing ------------------------------------------------------------

def utm_rules(vocab: Vocabulary) -> list[tuple[str, str, tuple[str, str, str]]]:
    """(source, medium, (category, channel, sub-channel)); later rows win."""
    newsletters = [(brand, "email", (V.PERFORMANCE, "Email", "Newsletter")) for brand in vocab.brands]
    return [
        ("facebook", "paid_social", (V.PERFORMANCE, "Paid Social", "Facebook")),
        ("google", "cpc", (V.PERFORMANCE, "SEM - Performance", "Google")),
        *newsletters,
        ("blog", "organic", (V.PERFORMANCE, "Organic", "Newsletter")),
        ("blog", "email", (V.PERFORMANCE, "Organic", "Newsletter")),
        ("google", "organic", (V.BRAND, "Organic", "Google")),
        ("m.facebook.com", "referral", (V.BRAND, "Social", "Facebook")),
        ("facebook.com", "referral", (V.BRAND, "Social", "Facebook")),
    ]


UTM_LABELS = ("mapped_category", "mapped_channel", "mapped_sub_channel")


def utm_rule_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """The rules above as rows for :func:`ordermetrics.operators.rules.labelled`; later ones have the greater priority."""
    rows = [(s, m, n, *labels) for n, (s, m, labels) in enumerate(utm_rules(vocab))]
    rows.append((MISSING, MISSING, len(rows), V.BRAND, "Organic", "Direct"))
    return spark.createDataFrame(rows, "utm_source string, utm_medium string, priority int, " + ", ".join(f"{c} string" for c in UTM_LABELS))


def with_utm_mapping(df: DataFrame, source: str = "utm_source", medium: str = "utm_medium", rules=None, *, vocab: Vocabulary) -> DataFrame:
    """Add mapped_category, mapped_channel and mapped_sub_channel (null when no rule fits)."""
    untracked = F.col(source).isNull() & F.col(medium).isNull()
    table = utm_rules(vocab) if rules is None else rules
    names = UTM_LABELS
    direct = (V.BRAND, "Organic", "Direct")
    return df.withColumns(
        {
            name: last_match(
                [((F.col(source) == s) & (F.col(medium) == m), labels[i]) for s, m, labels in table]
                + [(untracked, direct[i])]
            )
            for i, name in enumerate(names)
        }
    )


def paid_pairs(vocab: Vocabulary) -> list[tuple[str, str]]:
    """(source, medium) pairs that count as paid acquisition (fixed values)."""
    return [
        ("facebook", "paid_social"),
        ("facebook", "paid"),
        ("facebook", "cpc"),
        ("google", "cpc"),
        ("bing", "cpc"),
        *[(brand, "email") for brand in vocab.brands],
        ("Blog", "email"),
    ]


def paid_rule_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """The paid pairs as rule rows; all give one label."""
    rows = [(s, m, 0, V.PERFORMANCE) for s, m in paid_pairs(vocab)]
    return spark.createDataFrame(rows, "utm_source string, utm_medium string, priority int, mapped_category string")


def paid_category(source: Column | str = "utm_source", medium: Column | str = "utm_medium", *, vocab: Vocabulary) -> Column:
    source, medium = as_column(source), as_column(medium)
    return first_match([((source == s) & (medium == m), V.PERFORMANCE) for s, m in paid_pairs(vocab)])


# --- labels over arrays ---------------------------------------------------

def upgrade_by_label(values: Column | str, *, vocab: Vocabulary) -> Column:
    """'Upgrade' when the array holds one of the exact labels, else null."""
    labels = F.array(*[F.lit(x) for x in vocab.upgrade_labels])
    return F.when(F.arrays_overlap(as_column(values), labels), F.lit("Upgrade"))


def value_has_upgrade_phrase(value: Column | str, *, vocab: Vocabulary) -> Column:
    """Case-sensitive search for the upgrade phrases in one metadata value."""
    value = as_column(value)
    return value.contains("Upgraded from") | value.contains(f"{vocab.starter_brand.capitalize()} upgrade")


def upgrade_by_pattern(values: Column | str, *, vocab: Vocabulary) -> Column:
    """True when any array element has the phrase."""
    return F.coalesce(F.exists(as_column(values), lambda x: value_has_upgrade_phrase(x, vocab=vocab)), F.lit(False))


def program_category(program: Column | str = "program") -> Column:
    return code_label(program, V.PROGRAM_LABELS, V.OTHER_PROGRAMS)


def sample_flag(order_id: Column | str = "order_id", sample_id: Column | str = "sample_id") -> Column:
    return first_match(
        [(as_column(order_id).isNull(), None), (as_column(sample_id).isNotNull(), "Sample Received")],
        "Sample Not Received",
    )


def returned_flag(state: Column | str = "order_state") -> Column:
    return F.when(in_list(state, V.RETURNED_STATES), F.lit("Yes")).otherwise(F.lit("No"))


# --- claims and turnaround ------------------------------------------------

def claim_prediction(created_at: Column | str, start, end) -> Column:
    """Whether an approved order is expected to become a claim inside the range.

    A claim follows 17 to 52 days after the order (45 for the lower bound).
    """
    created = as_column(created_at)
    earliest, latest = created + F.expr("INTERVAL 17 DAYS"), created + F.expr("INTERVAL 52 DAYS")
    return first_match(
        [
            ((created + F.expr("INTERVAL 45 DAYS") >= moment(start)) & (latest < moment(end)), "lower_bound"),
            ((earliest < moment(end)) & (latest > moment(end)), "upper_bound"),
        ]
    )


def turnaround_band(days: Column | str) -> Column:
    days = as_column(days)
    *bounded, (rest, _) = V.TURNAROUND_BANDS
    return first_match([(days.isNull(), None)] + [(days <= limit, name) for name, limit in bounded], rest)
