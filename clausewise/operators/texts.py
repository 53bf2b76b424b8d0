"""Column rules of parsing, canonical form and extraction: each is one expression, none needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.constants import CREDENTIAL_PARAMS, CREDENTIAL_PLACEHOLDER, MODALS, PERMISSIVE, TAXONOMY, VOLATILE_FIELDS

# Numbering alphabets of statutes (circled digits to 35, sub-item letters, Roman numerals to 12).
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳㉑㉒㉓㉔㉕㉖㉗㉘㉙㉚㉛㉜㉝㉞㉟"
MOK = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허"
ROMAN = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ"

# Fixed values: (style, pattern, text must follow), tried in this order, since the later ones are looser.
MARKERS = (
    ("chapter", r"^제(\d+)(편|장|절|관)(?:의(\d+))?\s*(.*)$", False),
    ("article", r"^제(\d+)조(?:의(\d+))?\s*(?:\(([^)]*)\))?\s*(.*)$", False),
    ("roman_dot", rf"^([{ROMAN}]|[IVX]{{1,4}})\.\s*(.*)$", True),
    ("circled", rf"^([{CIRCLED}])\s*(.*)$", False),
    ("dotted", r"^(\d+(?:\.\d+)+)\.?\s+(.*)$", True),
    ("digit_dot", r"^(\d+)(?:의(\d+))?\.\s*(.*)$", True),
    ("digit_paren", r"^(\d+)(?:의(\d+))?\)\s*(.*)$", True),
    ("hangul_dot", rf"^([{MOK}])\.\s*(.*)$", True),
    ("hangul_paren", rf"^([{MOK}])\)\s*(.*)$", True),
    ("bullet", r"^[-–—·ㆍ*○●□■]\s+(.*)$", True),
)
# How loosely a style binds on the legal ladder, and how deep a chapter's kind nests.
RANKS = {"chapter": 1, "article": 2, "roman_dot": 2, "circled": 3, "dotted": 4, "digit_dot": 4, "hangul_dot": 5, "digit_paren": 6, "hangul_paren": 7, "bullet": 8}
CHAPTER_DEPTH = {"편": 1, "장": 2, "절": 3, "관": 4}
_LAST_GROUP = {"chapter": 4, "article": 4, "roman_dot": 2, "circled": 2, "dotted": 2, "digit_dot": 3, "digit_paren": 3, "hangul_dot": 2, "hangul_paren": 2, "bullet": 1}


def marker_style(line: Column) -> Column:
    """The style of the marker a line opens with; null where the line continues the unit above it."""
    s, out = F.trim(line), None
    for style, pattern, needs in MARKERS:
        hit = s.rlike(pattern)
        if needs:
            hit &= F.trim(F.regexp_extract(s, pattern, _LAST_GROUP[style])) != ""
        out = F.when(hit, style) if out is None else out.when(hit, style)
    return out


def _part(s: Column, style: str, group: int) -> Column:
    return F.regexp_extract(s, {a: b for a, b, _ in MARKERS}[style], group)


def article_segment(number: Column, branch: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.coalesce(branch, F.lit(""))), "^0+", "")
    return F.concat(F.lit("제"), F.trim(number), F.lit("조"), F.when(bare != "", F.concat(F.lit("의"), bare)).otherwise(""))


def paragraph_segment(mark: Column) -> Column:
    """``제N항`` of a circled digit; null without one, since an unnumbered paragraph is no part of an address."""
    number = F.try_element_at(F.create_map(*(x for k, c in enumerate(CIRCLED, 1) for x in (F.lit(c), F.lit(k)))), F.trim(mark)).cast("string")
    return F.concat(F.lit("제"), number, F.lit("항"))


def item_segment(raw: Column) -> Column:
    """``2의2.`` is ``제2호의2``."""
    s = F.trim(raw)
    branch = _part(s, "digit_dot", 2)
    numbered = F.concat(F.lit("제"), _part(s, "digit_dot", 1), F.lit("호"), F.when(branch != "", F.concat(F.lit("의"), branch)).otherwise(""))
    return F.when(s.rlike(r"^\d+(의\d+)?\."), numbered).otherwise(F.concat(F.lit("제"), F.regexp_replace(s, r"\.+$", ""), F.lit("호")))


def subitem_segment(raw: Column) -> Column:
    return F.concat(F.regexp_replace(F.trim(raw), r"\.+$", ""), F.lit("목"))


def marker_segment(line: Column) -> Column:
    """How a marker is cited: the unit after the number, its branch after the unit; bullets have no number."""
    s = F.trim(line)
    branch = lambda x: F.when(x != "", F.concat(F.lit("의"), x)).otherwise("")
    style = marker_style(line)
    return (
        F.when(style == "chapter", F.concat(F.lit("제"), _part(s, "chapter", 1), _part(s, "chapter", 2), branch(_part(s, "chapter", 3))))
        .when(style == "article", article_segment(_part(s, "article", 1), _part(s, "article", 2)))
        .when(style == "roman_dot", _part(s, "roman_dot", 1))
        .when(style == "circled", paragraph_segment(_part(s, "circled", 1)))
        .when(style == "dotted", _part(s, "dotted", 1))
        .when(style == "digit_dot", item_segment(s))
        .when(style == "digit_paren", F.concat(_part(s, "digit_paren", 1), branch(_part(s, "digit_paren", 2)), F.lit(")")))
        .when(style == "hangul_dot", subitem_segment(_part(s, "hangul_dot", 1)))
        .when(style == "hangul_paren", F.concat(_part(s, "hangul_paren", 1), F.lit(")")))
        .when(style == "bullet", "")
    )


def marker_depth(line: Column) -> Column:
    """Nesting inside one rank: the kind of a chapter, the parts of a dotted number, else 1."""
    s, style = F.trim(line), marker_style(line)
    depth = F.create_map(*(x for k, v in CHAPTER_DEPTH.items() for x in (F.lit(k), F.lit(v))))
    return F.when(style == "chapter", F.try_element_at(depth, _part(s, "chapter", 2))).when(style == "dotted", F.size(F.split(_part(s, "dotted", 1), r"\."))).otherwise(1)


def marker_heading(line: Column) -> Column:
    s, style = F.trim(line), marker_style(line)
    return F.when(style == "chapter", F.nullif(F.trim(_part(s, "chapter", 4)), F.lit(""))).when(style == "article", F.nullif(_part(s, "article", 3), F.lit("")))


def logical_lines(text: Column) -> Column:
    """Lines, broken also before a paragraph mark inside a line."""
    return F.filter(F.split(F.regexp_replace(text, rf"(?<=\S)\s+(?=[{CIRCLED}])", "\n"), "\n", -1), lambda x: F.trim(x) != "")


def normalize_text(text: Column) -> Column:
    """Line ends as \\n, no blanks at line ends, two newlines at most, stripped; give it ``functions.nfc`` of a text for the canonical form."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t\x0B\f]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def canonical_record(record: Column) -> Column:
    """A map as sorted ``key<tab>value`` lines without volatile keys."""
    fold = lambda k: F.lower(F.regexp_replace(k, r"\s+", ""))
    names = sorted({v.replace(" ", "").lower() for v in VOLATILE_FIELDS})
    kept = F.filter(F.array_sort(F.map_entries(record)), lambda e: ~fold(e["key"]).isin(*names))
    return F.concat_ws("\n", F.transform(kept, lambda e: F.concat(e["key"], F.lit("\t"), F.coalesce(e["value"], F.lit("")))))


def authority_date(raw: Column) -> Column:
    """A date written as eight digits, with or without ``-`` or ``.`` between its parts; null where it is none."""
    form = r"^\s*(\d{4})[-.]?(\d{2})[-.]?(\d{2})\s*$"
    plain = F.concat_ws("-", *(F.regexp_extract(raw, form, k) for k in (1, 2, 3)))
    return F.when(raw.rlike(form), F.try_to_date(plain, "yyyy-MM-dd"))


def redacted(url: Column) -> Column:
    return F.regexp_replace(url, rf"(?<=[?&])({'|'.join(CREDENTIAL_PARAMS)})=[^&#]*", f"$1={CREDENTIAL_PLACEHOLDER.replace('{', chr(92) + '{')}")


def annex_number(raw: Column) -> Column:
    """Numbers without the zeros before them; other numbering as it stands."""
    bare = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(bare.rlike(r"^\d+$"), F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(bare)


def annex_label(kind: Column, number: Column, branch: Column) -> Column:
    return F.concat(kind, annex_number(number), F.when(annex_number(branch).isin("", "0"), "").otherwise(F.concat(F.lit("의"), annex_number(branch))))


def filler_to_null(ref: Column) -> Column:
    return F.when(~F.trim(ref).rlike("^0*$"), F.trim(ref))


def yes_no(flag: Column) -> Column:
    return F.when(F.upper(F.trim(flag)) == "Y", True).when(F.upper(F.trim(flag)) == "N", False)


def coerced(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(F.lower(F.trim(value)).isin(*allowed), F.lower(F.trim(value))).otherwise(default)


def zipped_row(header: Column, cells: Column) -> Column:
    """Header and cells as a map: missing cells are empty, surplus ones are named ``colN``."""
    n = F.greatest(F.size(header), F.size(cells))
    at = F.sequence(F.lit(0), n - 1)
    return F.map_from_arrays(
        F.transform(at, lambda k: F.coalesce(F.get(header, k), F.concat(F.lit("col"), (k + 1).cast("string")))), F.transform(at, lambda k: F.coalesce(F.get(cells, k), F.lit(""))))


def rendered_row(row: Column) -> Column:
    return F.concat_ws("\n", F.transform(F.filter(F.map_entries(row), lambda e: F.trim(e["value"]) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))


def normalized_label(label: Column) -> Column:
    """Gaps between Hangul syllables go, others become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(label, r"(?<=[가-힣])\s+(?=[가-힣])", ""), r"\s+", " "))


# ---------------------------------------------------------------- obligations


def found_modals(text: Column, language: str = "ko") -> Column:
    """Modals of the inventory that occur, in the inventory's order; an unknown language is an error."""
    if language not in MODALS:
        raise ValueError(f"no modal inventory for {language!r}")
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(m)) for m, p in MODALS[language].items())))


def has_permissive(text: Column, language: str = "ko") -> Column:
    return text.rlike(PERMISSIVE[language])


def title_of(heading: Column, body: Column) -> Column:
    inside = F.regexp_extract(body, r"^\s*제\d+조(?:의\d+)?\s*\(([^)]{1,60})\)", 1)
    return F.when(F.coalesce(heading, F.lit("")) != "", F.trim(heading)).otherwise(F.trim(inside))


# Titles and segments that settle a clause's role.
DEFINITION_TITLES = ("정의", "용어", "definitions")
SCOPE_TITLES = ("목적", "적용범위", "적용 범위", "purpose", "scope")
TRANSITIONAL = ("부칙",)
DELEGATION = r"(?:대통령령|총리령|부령|고시|정관)(?:으)?로\s*정(?:한다|하는)"
MIN_CHARS = 10


def triage(kind: Column, segments: Column, heading: Column, text: Column, language: str = "ko") -> Column:
    """Struct (kind, reason): structure, emptiness, transitional parts and titles come before the modal test."""
    body = F.trim(F.coalesce(text, F.lit("")))
    title = F.lower(title_of(heading, body))
    any_of = lambda needles: (title != "") & F.greatest(*(F.contains(title, F.lit(n)).cast("int") for n in needles), F.lit(0)).cast("boolean")
    out = lambda reason: F.struct(F.lit("excluded").alias("kind"), F.lit(reason).alias("reason"))
    return (
        F.when(kind == "heading", out("heading")).when(kind == "form", out("form")).when(kind == "table", out("table_container"))
        .when(F.length(body) < MIN_CHARS, out("empty"))
        .when(F.arrays_overlap(segments, F.array(*map(F.lit, TRANSITIONAL))), out("procedural"))
        .when(any_of(DEFINITION_TITLES), out("definition")).when(any_of(SCOPE_TITLES), out("scope"))
        .when(F.size(found_modals(body, language)) > 0, F.struct(F.lit("obligation_bearing").alias("kind"), F.lit(None).cast("string").alias("reason")))
        .when(body.rlike(DELEGATION), out("delegation")).when(has_permissive(body, language), out("permissive")).otherwise(out("no_obligation"))
    )


def canonical_taxonomy(raw: Column, domain: str) -> Column:
    code = F.regexp_replace(F.lower(F.trim(raw)), "[- ]", "_")
    return F.when(code.isin(*TAXONOMY[domain]), code)


def canonical_modal(raw: Column, language: str = "ko") -> Column:
    said = F.trim(raw)
    out = F.when(said.isin(*MODALS[language]), said)
    for modal, pattern in MODALS[language].items():
        out = out.when(said.rlike(pattern), modal)
    return out


# ---------------------------------------------------------------- filing clauses

# What makes a clause list documents to file, and what its items say.
ENUMERATES = "다음 각 호"
DOCUMENTS = "서류|자료|서면|증명서|사본|신청서|보고서|계획서"
FILES = r"첨부하(여|아|여야|은)|첨부해|제출하여야|제출해야|제출하여|갖추어|구비하(여|아)"
NO_LIST = r"다음 각 호의\s*(사항|기준|요건|어느 하나|경우)"
EXEMPTS = r"(제출|첨부)하지\s*(아니|않)|면제(한다|할 수)"
CONDITIONAL = "에도 불구하고|경우|한정한|제외한|다만|에 한하여|만 해당"
ITEM_DELEGATES = r"(대통령령|총리령|부령|고시|훈령|예규)(?:으)?로\s*정(?:하는|한다)"
SUB_ITEMS = "다음 각 목"
CROSS_INSTRUMENT = r"법\s*제\d+조|「[^」]{2,40}」\s*제\d+조"
FORM = r"별지\s*제\s*\d+(?:호의\d+)?\s*호?서식"


def is_filing(text: Column, kind: Column) -> Column:
    return (kind == "prose") & text.contains(ENUMERATES) & text.rlike(DOCUMENTS) & text.rlike(FILES) & ~text.rlike(NO_LIST) & ~text.rlike(EXEMPTS)


def filing_items(clauses: DataFrame) -> DataFrame:
    """version_id, path, items, sub_items: the children of each clause (ordinal, parent_ordinal) in order, and the paths of theirs."""
    child = clauses.select("version_id", F.col("parent_ordinal").alias("ordinal"), F.struct("ordinal", "path").alias("child"), F.col("ordinal").alias("__own"))
    grand = clauses.select("version_id", F.col("parent_ordinal").alias("__own"), F.struct("ordinal", "path").alias("grand"))
    by = child.join(grand, ["version_id", "__own"], "left").groupBy("version_id", "ordinal").agg(F.sort_array(F.collect_set("child"))["path"].alias("items"), F.sort_array(F.collect_set("grand"))["path"].alias("sub_items"))
    return clauses.select("version_id", "ordinal", "path").join(by, ["version_id", "ordinal"])


def item_flags(text: Column, children: Column) -> Column:
    """Struct (conditional, delegates, has_sub_items) of an item."""
    return F.struct(text.rlike(CONDITIONAL).alias("conditional"), text.rlike(ITEM_DELEGATES).alias("delegates"), ((F.size(children) > 0) | text.contains(SUB_ITEMS)).alias("has_sub_items"))


def form_reference(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, FORM, 0), r"\s+", " "), F.lit(""))


def caveats(text: Column, items: Column) -> Column:
    """Reasons, in fixed order, not to read the list as settled; none makes it definitive."""
    some = lambda pattern: F.exists(items, lambda i: i.rlike(pattern))
    return F.array_compact(F.array(
        F.when(text.rlike(CONDITIONAL), "conditional_procedure"), F.when(some(CONDITIONAL), "conditional_items"), F.when(some(ITEM_DELEGATES), "delegated_items"),
        F.when(some(SUB_ITEMS), "nested_items"), F.when(text.rlike(CROSS_INSTRUMENT), "cross_instrument"), F.when(F.size(items) == 0, "no_items_parsed")))


# ---------------------------------------------------------------- discovery


def folded(title: Column) -> Column:
    """Lower case without blanks and middle dots; give it ``functions.nfc`` of a title where its form may vary."""
    return F.translate(F.lower(title), " ·ㆍ\t", "")


def keyword_cells(title: Column, keywords: dict[str, tuple[str, ...]], exclusions: tuple[str, ...]) -> Column:
    """Cells whose keyword occurs; an exclusion term anywhere beats all of them."""
    t = folded(title)
    hits = F.array_compact(F.array(*(F.when(F.greatest(*(F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, F.lit(cell)) for cell, words in keywords.items())))
    return F.when(first_exclusion(title, exclusions).isNull(), hits).otherwise(F.array().cast("array<string>"))


def first_exclusion(title: Column, exclusions: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(F.contains(folded(title), F.lit(w)), F.lit(w)) for w in exclusions), F.lit(None).cast("string"))
