"""Readable names for engineered columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Report labels of engineered and raw columns.
LABELS = {
    "_log_dist_1_2": "Billing-to-shipping distance (log)",
    "_hour_cos": "Hour of day (cyclic, cosine)",
    "_hour_sin": "Hour of day (cyclic, sine)",
    "_weekday__hour": "Weekday x hour slot",
    "_P_emaildomain__ProductCD": "Email domain x product code",
    "_card3__card5": "Card issuer x card sub-type",
    "_day_lag_uid2": "Seconds since this card last transacted",
    "_amount_lag_pct_uid2": "Amount change vs this card previous transaction",
    "_uid2_seq_index": "Transaction number in this card history",
    "_amount_decimal": "Cents portion of the amount",
    "_amount_decimal_len": "Number of decimal places in the amount",
    "_log_amount": "Transaction amount (log)",
    "_all_na": "Count of missing fields in the row",
    "_ccols_nonzero": "Count of non-zero counter features",
    "_ccols_sum": "Sum of counter features",
    "_ccols_0_bin": "Which counter features are zero (pattern)",
    "_dcol_na": "Count of missing timedelta features",
    "_dcols_na_bin": "Which timedelta features are missing (pattern)",
    "_mcols_na_bin": "Which match-flag features are missing (pattern)",
    "_vcols_dec0": "Vesta feature block, principal component 1",
    "_vcols_dec1": "Vesta feature block, principal component 2",
    "_vcols_na": "Count of missing Vesta features",
    "_vcols_sum": "Sum of Vesta features",
    "_unseen__uid2": "Card not seen during training",
    "_unseen__P_emaildomain__ProductCD": "Email x product pair not seen in training",
    "uid2": "card identity",
    "P_emaildomain__ProductCD": "email domain x product",
    "TransactionAmt": "Transaction amount",
    "ProductCD": "Product code",
    "card1": "Card identifier 1",
    "card2": "Card identifier 2",
    "card3": "Card issuer country code",
    "card5": "Card sub-type code",
    "card4": "Card network (Visa/Mastercard/...)",
    "card6": "Card funding type (debit/credit)",
    "addr1": "Billing address region",
    "addr2": "Billing address country",
    "dist1": "Billing-to-shipping distance",
    "dist2": "Secondary distance measure",
    "P_emaildomain": "Purchaser email domain",
    "R_emaildomain": "Recipient email domain",
}

# Numbered column families and their wording.
FAMILIES = {"C": "Address/card counter ", "D": "Days since prior event ", "M": "Match flag ", "V": "Vesta engineered feature "}


def _base_label(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    out = F.when(name.startswith("id_"), F.concat(F.lit("Identity/device attribute "), F.substr(name, F.lit(4)))).otherwise(name)
    for letter, text in FAMILIES.items():
        digits = F.regexp_extract(name, f"^{letter}(\\d+)$", 1)
        out = F.when(digits != "", F.concat(F.lit(text), digits)).otherwise(out)
    return F.coalesce(F.try_element_at(table, name), out)


def feature_label(name: Column) -> Column:
    """Table lookup first, then the frequency, aggregate and family rules."""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    freq = F.regexp_extract(name, r"^_freq_ref_(.+)$", 1)
    agg = r"^_(max|mean|var)_(.*?)(?:__(.*))?$"
    kind, col = F.regexp_extract(name, agg, 1), F.regexp_extract(name, agg, 2)
    group = F.ltrim(F.regexp_extract(name, agg, 3), F.lit("_"))
    return F.coalesce(
        F.try_element_at(table, name),
        F.when(freq != "", F.concat(F.lit('How common this value of "'), _base_label(freq), F.lit('" was in training'))),
        F.when(kind != "", F.concat(F.initcap(kind), F.lit(' of "'), _base_label(col), F.lit('" per "'), _base_label(group), F.lit('"'))),
        _base_label(name))
