"""Display helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revtrail.functions.text import trim_ws, utf16_length
from revtrail.schemas import SEVERITY_LABELS, TAG_LABELS, TAGS

# What an address and a slug may look like.
EMAIL = "^[A-Za-z0-9_'+\\-]+(\\.[A-Za-z0-9_'+\\-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{2,}$"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "d MMM yyyy")


def format_date_time(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "d MMM yyyy, HH:mm"), F.lit(" UTC"))


def format_percent(ratio: Column) -> Column:
    """0%, <0.1%, one decimal below 1 %, else a whole number."""
    return F.when(ratio == 0, "0%").when(ratio < 0.001, "<0.1%").when(ratio < 0.01, F.format_string("%.1f%%", ratio * 100)).otherwise(F.concat(F.floor(ratio * 100 + 0.5).cast("string"), F.lit("%")))


def pluralize(count: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, singular).otherwise(plural or f"{singular}s"))


def severity_label(severity: Column) -> Column:
    out = F.lit("Unrated")
    for value, label in SEVERITY_LABELS.items():
        out = F.when(severity == value, label).otherwise(out)
    return out


def tag_label(tag: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, label in TAG_LABELS.items():
        out = F.when(tag == value, label).otherwise(out)
    return out


def known_tags(tags: Column, keep: int | None = None) -> Column:
    known = F.filter(tags, lambda t: t.isin(*TAGS))
    return known if keep is None else F.slice(known, 1, keep)


def document_label(kind: Column) -> Column:
    return F.when(kind == "tos", "Terms of Service").otherwise("Privacy Policy")


def monogram(name: Column) -> Column:
    return F.upper(F.substring(trim_ws(name), 1, 1))


def headline_size(headline: Column) -> Column:
    n = utf16_length(headline)
    return F.when(n > 110, 46).when(n > 70, 54).otherwise(64)


def escape_html(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape_html(c: Column) -> Column:
    """The reverse of escape_html."""
    for plain, safe in (('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def clean_email(c: Column) -> Column:
    """Trimmed and lower-cased; null unless well formed and at most 254 long."""
    e = F.lower(trim_ws(c))
    return F.when(e.rlike(EMAIL) & (F.length(e) <= 254), e)


def valid_slug(c: Column) -> Column:
    return F.length(c).between(1, 80)


def valid_token(c: Column) -> Column:
    return c.rlike(UUID)


def change_state(cosmetic: Column, published: Column) -> Column:
    return F.when(cosmetic, "cosmetic").when(published, "published").otherwise("held for review")


def subscription_state(unsubscribed_at: Column) -> Column:
    return F.when(unsubscribed_at.isNull(), "active").otherwise("unsubscribed")
