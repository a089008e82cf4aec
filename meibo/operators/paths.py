"""Pages to read next for each focus: a page's links, and guessed addresses of its site before or after them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meibo.functions.derive import text
from meibo.operators import pages as p

# Addresses that company sites often have, and those of a focus, in order.
COMMON_PATHS = (
    "/company.html", "/company/", "/company/index.html", "/company/outline.html", "/company/profile.html", "/company/message.html", "/company/greeting.html", "/company/access.html", "/company/gaiyou.html",
    "/company/overview.html", "/company/about/", "/company/data/", "/company/numbers/", "/company/numbers.html", "/numbers/", "/numbers/index.html", "/recruit/", "/recruit/data/", "/recruit/company/",
    "/companyinfo.html", "/profile.html", "/about.html", "/about/", "/aboutus/", "/aboutus/company-outline/", "/corporate.html", "/corporate/", "/corporate/profile/", "/outline.html", "/gaiyou.html", "/overview.html",
    "/information.html", "/message.html", "/greeting.html", "/staff.html", "/member.html", "/office.html", "/access.html", "/contact.html", "/data/", "/data/index.html", "/about/chubu/index.html",
    "/chubu/office/greeting.html", "/domestic/chubu/office/greeting.html", "/office/greeting.html", "/aisatsu.html", "/greeting/president.html", "/president.html", "/president/message.html", "/ceo-message.html",
    "/topmessage.html", "/message/president.html", "/about/message.html", "/about/greeting.html", "/company/topmessage.html", "/company/president.html", "/corporate/message.html", "/corporate/greeting.html",
    "/about/outline/", "/about/company/", "/company/about/", "/company/info/", "/kaisya.html", "/kaisya/gaiyou.html", "/company/about.html", "/company/overview/", "/company/outline/", "/company/profile/",
    "/company/message/", "/company/greeting/", "/corporate/about/", "/corporate/outline/", "/corporate/company/", "/outline/", "/profile/", "/company/", "/kaisha/", "/company/base/",
)
FOCUS_PATHS = {
    "company_core": ("/company/", "/company/index.html", "/company/outline.html", "/company/profile.html", "/company/overview.html", "/about/", "/about.html", "/profile/", "/profile.html", "/outline.html", "/overview.html"),
    "contact": (
        "/company/", "/company/index.html", "/company.html", "/company/outline.html", "/company/profile.html", "/company/overview.html", "/company/info/", "/company/about/", "/about/", "/about.html", "/about/company/",
        "/profile/", "/profile.html", "/outline.html", "/overview.html", "/access/", "/access.html", "/company/access.html", "/contact/", "/contact.html", "/inquiry/", "/inquiry.html",
    ),
    "representative": (
        "/company/", "/group/", "/group/index.html", "/company.html", "/company/index.html", "/company/outline.html", "/company/profile.html", "/company/overview.html", "/company/message.html", "/company/greeting.html",
        "/company-profile/", "/company-profile.html", "/company-profile/index.html", "/message.html", "/greeting.html", "/president.html", "/topmessage.html",
    ),
    "employee_count": (
        "/company/", "/company", "/company/index.html", "/company.html", "/company/outline.html", "/company/profile.html", "/company/overview.html", "/company/outline/", "/company/profile/", "/company/overview/",
        "/company/data/", "/company/data.html", "/company/numbers/", "/company/numbers.html", "/company/info/", "/company/info.html", "/company-profile/", "/company-profile.html", "/company-profile/index.html", "/about/",
        "/about.html", "/about/company/", "/profile/", "/profile.html", "/profile/index.html", "/outline.html", "/overview.html", "/numbers/", "/numbers/index.html", "/data/", "/data/index.html",
    ),
    "business_content": ("/business/", "/business.html", "/service/", "/service.html", "/company/", "/company/profile.html", "/company/overview.html", "/about/"),
    "permit": (
        "/company/", "/company/profile.html", "/company/overview.html", "/company/info/", "/license/", "/license.html", "/licence/", "/licence.html", "/permit/", "/permit.html", "/permission/", "/permission.html",
        "/company/license/", "/company/license.html", "/company/permit/", "/company/permit.html", "/company/profile/", "/company/outline/", "/company/outline.html", "/about/license/", "/about/license.html", "/about/permit/",
        "/about/permit.html", "/service/haken/", "/service/haken.html", "/service/jinzai/", "/service/jinzai.html", "/temporary-staffing/", "/temporary-staffing.html", "/recruitment/", "/recruitment.html", "/haken/",
        "/haken.html", "/jinzai/", "/jinzai.html",
    ),
}
#: The focus whose guessed addresses come before its links.
GUESSED_FIRST = "company_core"
#: The most pages of any focus.
MOST = max(most for _, most, _ in p.LINK_LIMITS.values())


def guessed_paths(focus: str) -> list[str]:
    """The addresses guessed for a focus, each once, in order."""
    return list(dict.fromkeys((*COMMON_PATHS, *FOCUS_PATHS[focus])))


def _words(focus: str) -> list[tuple[str, int]]:
    """Words and points of a focus; the last two of head counts only tell recruiting pages apart."""
    return [*p.LINK_RULES[focus], *([(p.RECRUIT, 0), (p.HEADCOUNT, 0)] if focus == "employee_count" else [])]


def _lows(focus: str) -> list[int]:
    """The points of a focus, less than nothing, by the words that are hit (a bit for each)."""
    words = _words(focus)
    jobs, staff = 1 << (len(words) - 2), 1 << (len(words) - 1)
    barred = lambda mask: focus == "employee_count" and mask & jobs and not mask & staff
    return [(250 if barred(mask) else 0) - sum(points for n, (_, points) in enumerate(words) if mask >> n & 1) for mask in range(1 << len(words))]


def _sites(pages: DataFrame, key: str, url: str) -> DataFrame:
    """(key, head, own): the site of each page, and for each focus the words that the site itself holds.

    The words are looked for before anything is exploded, once for each page and not for each guessed address.
    """
    site = F.lower(F.regexp_extract(text(url), r"(?i)^(https?://[^/?#]+)", 1))
    hit = lambda focus: sum((F.when(F.col("head").rlike(f"(?i){w}"), 1 << n).otherwise(0) for n, (w, _) in enumerate(_words(focus))), F.lit(0))
    return pages.select(key, site.alias("head")).where("head <> ''").select(key, "head", F.array(*[hit(f) for f in p.LINK_LIMITS]).alias("own"))


def _guessed(focus: str, n: int) -> Column:
    """The guessed addresses of ``sites`` in order, scored as links of their own path's label.

    No word of a rule holds a slash, so a word is in an address if it is in the site or in the path. The
    paths' words are known beforehand; they stand as a site without words orders them, which most are, so
    that little is left to sort.
    """
    lows = _lows(focus)
    masks = [(path, sum(bool(re.search(w, path, re.IGNORECASE)) << k for k, (w, _) in enumerate(_words(focus)))) for path in guessed_paths(focus)]
    ordered = sorted(enumerate(masks), key=lambda g: (lows[g[1][1]], g[0]))
    # in one expression each: a Column for every value takes seconds to build
    paths = F.expr(f"array({', '.join(f"named_struct('n', {k}, 'path', '{path}', 'mask', {mask})" for k, (path, mask) in ordered)})")
    points = F.expr(f"array({', '.join(map(str, lows))})")
    low = lambda s, g: F.get(points, F.get(s["own"], F.lit(n)).bitwiseOR(g["mask"]))
    one = lambda s: F.transform(paths, lambda g: F.struct(low(s, g).alias("low"), g["n"].alias("n"), s["head"].alias("head"), g["path"].alias("path")))
    return F.sort_array(F.flatten(F.transform("sites", one)))


def _address(r: Column) -> Column:
    return F.concat(r["head"], r["path"])


def candidate_pages(pages: DataFrame, links: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, focus, link, score, place, guessed): the pages to read for each focus, of a page's links and of guessed addresses.

    Links are of the page's own site and above the focus's least score; guessed addresses follow them, but
    for the company itself come first. Both go by score, then by their own order. An address stands in its
    first place only. Only links and sites are shuffled: the guessed addresses, many for each page, are put
    in order and cut within the row that holds a page's links. No row holds more of them than ``MOST`` for
    each focus, nor more sites for each set of words that they hold; more can have no place.
    """
    own = p.focus_scores(links.where(F.col("same_origin") & ~text("link").rlike(f"(?i){p.DENIED}")))
    each = [F.struct(F.lit(f).alias("focus"), F.col(f"score_{f}").alias("score"), F.lit(low).alias("least")) for f, (low, _, _) in p.LINK_LIMITS.items()]
    real = own.select(key, "link", "seq", F.inline(F.array(*each))).where("score > least")
    real = real.select(key, "focus", (-F.col("score")).alias("low"), F.col("seq").alias("n"), F.col("link").alias("head"), F.lit(None).cast("array<int>").alias("own"))
    sites = _sites(pages, key, url).select(key, F.lit("").alias("focus"), F.lit(0).alias("low"), F.lit(0).alias("n"), "head", "own")
    once = real.unionByName(sites).groupBy(key, "focus", "head", "own").agg(F.min(F.struct("low", "n")).alias("at"))
    place = F.row_number().over(Window.partitionBy(key, "focus", "own").orderBy("at", "head"))
    first = once.withColumn("place", place).where(F.col("place") <= MOST)
    link = F.struct("at.low", "at.n", "head", F.lit("").alias("path"))
    held = first.groupBy(key).agg(
        F.collect_list(F.when(F.col("focus") == "", F.struct("head", "own"))).alias("sites"),
        *[F.sort_array(F.collect_list(F.when(F.col("focus") == f, link))).alias(f"real_{f}") for f in p.LINK_LIMITS],
    )
    held = held.select(key, *[f"real_{f}" for f in p.LINK_LIMITS], *[_guessed(f, n).alias(f"made_{f}") for n, f in enumerate(p.LINK_LIMITS)])
    kinds = {f: ("made", "real") if f == GUESSED_FIRST else ("real", "made") for f in p.LINK_LIMITS}
    held = held.select("*", *[F.transform(f"{kinds[f][0]}_{f}", _address).alias(f"stand_{f}") for f in p.LINK_LIMITS])  # once, not for each address that is looked up
    taken = []
    for f, (_, most, _) in p.LINK_LIMITS.items():
        a, b = (F.col(f"{kind}_{f}") for kind in kinds[f])
        others = F.when(F.size(a) == 0, b).otherwise(F.filter(b, lambda r: ~F.array_contains(f"stand_{f}", _address(r))))  # noqa: B023
        taken.append(F.struct(F.lit(f).alias("focus"), F.slice(F.concat(a, others), 1, most).alias("rows")))
    rows = held.select(key, F.inline(F.array(*taken))).select(key, "focus", F.posexplode("rows").alias("place", "r"))
    return rows.select(key, "focus", _address(F.col("r")).alias("link"), (-F.col("r.low")).alias("score"), (F.col("place") + 1).alias("place"), (F.col("r.path") != "").alias("guessed"))
