"""Ordered, auditable rules for which filings are kept.

Rules are data: each has a pattern, made from phrases by the helpers below, and a reason.
The first that matches decides, and its pattern is the record of why.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REASONS = ("confidential", "pii_risk", "procedural", "non_text", "out_of_scope")
SEALED_TYPES = ("CONF",)

ORGANISATION_WORDS = """
 ADVOCATES AEP ALLIANCE AMERICA ASSOCIATION ASSOCIATIONS CHURCH CITIES CITY CO COALITION COMMISSION COMPANY CONSUMERS CORP
 CORPORATION COUNTY DEVELOPMENT DISTRICT ELECTRIC ENERGY GROUP H-E-B HEB HOLDINGS INC INVESTORS LEGAL LLC LP LTD MANAGEMENT
 MARKETS MGMT NORTH OPDM OPUC PARTNERS POWER PUC RECORDS REFORM REPORTING SERVICE SERVICES SOAH SOLAR STAFF STATE TCUC TEAM
 TEXAS TIEC UTILITIES UTILITY WALMART
""".split()


def _w(*phrases: str) -> str:
    """Any of the phrases as whole words."""
    return "|".join(rf"\b{p}\b" for p in phrases)


def _b(*phrases: str) -> str:
    """Any of the phrases at the beginning of a word."""
    return "|".join(rf"\b{p}" for p in phrases)


_CONF, _PII, _PROC, _NON, _OUT = REASONS
_STEPS = "admit intervene withdraw extend compel strike consolidate sever".split()
_NOTICES = "appearance filing change modification witness".split()
_PERSONS = ("commissioner", "chairman", "judge", r"mr\.", r"ms\.")

RULES: tuple[tuple[str, str], ...] = (
    *((p, _CONF) for p in (_b("confidential"), _w("highly sensitive"), _b("protective order certification"))),
    *((p, _PROC) for p in (_b("list of issu"), _w("procedural schedule"), _w("proposed notice", "recommendation on notice"), _w("moved to correct"), _w("affidavit of"))),
    *((p, _OUT) for p in (_w("prehearing conference", "hearing on the merits"), _b(r"pages \d+ ?- ?\d+"), _w("table of contents", "offer of proof"))),
    (_w("confidentiality statement"), _CONF),
    *((p, _PII) for p in (_w("ratepayer"), _w("letter of (protest|complaint)"), _w("protest"), _w("comments? (from|of|by)"), _b("customer (comment|complaint)"))),
    ("^comments?$", _PROC),
    (_b(rf"letter to\s+(?:the\s+)?[\s\w]*?({'|'.join(_PERSONS)})"), _PROC),
    (_w("correspondence"), _PROC),
    (_w(rf"(motion|petition) to\s+({'|'.join(_STEPS)})"), _PROC),
    (_w("certificate of service"), _PROC),
    (_w(f"notice of ({'|'.join(_NOTICES)})"), _PROC),
    *((_w(p), _PROC) for p in ("proof of publication", "agreed (motion|notice)", "entry of appearance", "mail log", "duplicate filing")),
    ("^void\\b|" + _w("void see item"), _PROC),
    (_w("wrong docket", "filed in the wrong docket"), _PROC),
    (_w("notice of (deposition|desposition)", "subpoena"), _PROC),
    *((_w(p), _PROC) for p in ("statement of position", "sent offsite", "placed on the agenda")),
    *((p, _OUT) for p in (_w("rfis?"), _w("requests? for information"), _w("errata"), _b("workpaper"))),
    *((_w(p), _NON) for p in ("native files", "flash drive", "bate stamp")),
)

#: Misspellings seen in descriptions, and what they are put right to, in order.
REPAIRS = tuple(
    (rf"\b{wrong}\b", right)
    for wrong, right in (x.split(">") for x in "confidentility>confidentiality certitfications?>certifications certifcations?>certifications rif>rfi rifs>rfis eratta>errata intitial>initial competative>competitive comissioners?>commissioners confernece>conference mertis>merits breif>brief novemebr>november novemeber>november".split())
)


def normalize_description(text: Column) -> Column:
    """Trimmed, white space single, known misspellings put right where one look finds any."""
    clean = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    out = clean
    for wrong, right in REPAIRS:
        out = F.regexp_replace(out, "(?i)" + wrong, right)
    return F.when(clean.rlike("(?i)" + "|".join(wrong for wrong, _ in REPAIRS)), out).otherwise(clean)


def looks_like_person(party: Column) -> Column:
    """Two or three name-shaped words, none of which belongs to an organisation. False for null and empty."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(party, ",", " "), r"\.", ". "), r"\s+"), lambda t: t != "")
    bare = F.transform(words, lambda t: F.regexp_replace(F.upper(t), r"\.+$", ""))
    organisation = F.arrays_overlap(bare, F.array(*(F.lit(w) for w in ORGANISATION_WORDS)))
    shaped = F.forall(words, lambda t: t.rlike(r"^[a-zA-Z][-'a-zA-Z]*[.]?$"))
    return F.coalesce(F.size(words).between(2, 3) & ~organisation & shaped, F.lit(False))


def hints(pattern: str) -> list[str]:
    """For each alternative of a pattern, a literal that all its matches hold in lower case: a cheap test before the pattern itself."""
    depth, parts = 0, [""]
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    out = []
    for part in parts:
        while "(" in part:
            part = re.sub(r"\([^()]*\)[?*]?", "\0", part)
        part = re.sub(r"\[[^]]*\][*?+]*|\\.[*+?]?|.[?*]|[$^]", "\0", part)
        out.append(max(part.split("\0"), key=len))
    if not all(out):
        raise ValueError(f"{pattern} may match without any literal")
    return out


def evaluate(item_type: Column, normal: Column, party: Column) -> Column:
    """A struct of include, reason and matched_rule. Kept unless a rule fires; null and empty say nothing.

    ``normal`` has to be a column of its own that holds the normalised description, or each rule would normalise it anew.
    """
    verdict = lambda reason, rule: F.struct(F.lit(False).alias("include"), F.lit(reason).alias("reason"), rule.alias("matched_rule"))
    sealed = F.upper(F.regexp_replace(item_type, r"^\s+|\s+$", "")).isin(*SEALED_TYPES)
    out = F.when(sealed, verdict(REASONS[0], F.concat(F.lit("item_type="), item_type)))
    out = out.when(looks_like_person(party), verdict("pii_risk", F.lit("filing_party=individual")))
    low = F.lower(normal)
    for pattern, reason in RULES:
        likely = reduce(Column.__or__, (low.contains(x) for x in dict.fromkeys(hints(pattern))))
        out = out.when(likely & normal.rlike("(?i)" + pattern), verdict(reason, F.lit(pattern)))
    none = F.lit(None).cast("string")
    return out.otherwise(F.struct(F.lit(True).alias("include"), none.alias("reason"), none.alias("matched_rule")))
