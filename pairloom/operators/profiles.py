"""Line-structured candidate pages: contact data, section slices, work history, education, quality checks.

Column expressions over one text column; map-only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.binding import let
from pairloom.functions.numbers import clamp, half_up
from pairloom.functions.text import lines, strip, unbulleted, word_count

# Section headers as (start, end, length limit), line patterns and default texts.
SUMMARY = (r"(?i)(?:summary|professional summary|about me|profile|executive summary)\s*[:\n]",
           r"(?i)\n\s*(?:experience|work experience|employment|education|skills|certifications|projects)\s*[:\n]", 500)
EXPERIENCE = (r"(?i)(?:experience|work experience|employment history|professional experience)\s*[:\n]",
              r"(?i)\n\s*(?:education|skills|certifications|projects|publications|awards)\s*[:\n]", None)
EDUCATION = (r"(?i)(?:education|academic background|qualifications)\s*[:\n]",
             r"(?i)\n\s*(?:skills|certifications|projects|experience|awards)\s*[:\n]", 600)
CERTIFICATIONS = (r"(?i)(?:certifications|certificates|licenses)\s*[:\n]",
                  r"(?i)\n\s*(?:education|skills|projects|experience|awards)\s*[:\n]", 400)
PROJECTS = (r"(?i)(?:projects|technical projects|portfolio projects)\s*[:\n]",
            r"(?i)\n\s*(?:education|skills|certifications|experience)\s*[:\n]", 600)
_MONTH = "(?:" + "|".join(fv.MONTHS) + ")"
ITEM_DATE = rf"(?i)(?:{_MONTH}[a-z]*\.?\s*)?\d{{4}}\s*[-–—to]+\s*(?:present|current|(?:{_MONTH}[a-z]*\.?\s*)?\d{{4}})"
FULL_DATE = (rf"(?i)(?:(?:\d{{1,2}}/)?{_MONTH}?[a-z]*\.?\s*|\d{{1,2}}/)?\d{{4}}\s*[-–—to]+\s*"
             rf"(?:present|current|now|(?:\d{{1,2}}/)?{_MONTH}?[a-z]*\.?\s*\d{{4}})")
DEGREE = (r"(?i)(?:bachelor|master|phd|doctorate|b\.?s\.?|m\.?s\.?|b\.?a\.?|m\.?a\.?|associate|bachelor of science|"
          r"master of science|b\.?tech|m\.?tech)[^,\n]*")
YEAR = r"\b(19\d{2}|20\d{2})\b"
NO_BULLETS = "Delivered key business initiatives and collaborated with cross-functional teams."
NO_BULLETS_LAST = "Led development and maintenance of core customer-facing applications."
PROJECT_NOTE = "Full-stack application delivering high-performance features."


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """First match, or NULL."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def without_first(text: Column, pattern: str) -> Column:
    """The text with its first match cut out."""
    halves = F.split(text, pattern, 2)
    return F.concat(F.get(halves, 0), F.coalesce(F.get(halves, 1), F.lit("")))


def section_slice(text: Column, start: str, end: str, limit: int | None) -> Column:
    """Text after the first start header up to the next end header, else its first limit characters; NULL without header."""
    after = F.get(F.split(text, start, 2), 1)
    cut = F.split(after, end, 2)
    rest = after if limit is None else F.substring(after, 1, limit)
    return F.when(F.size(cut) > 1, F.get(cut, 0)).otherwise(rest)


def contact(text: Column) -> Column:
    """(name, email, phone, location, linkedin, github, portfolio) with the page's defaults."""
    link = lambda url: F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    site = found(text, fv.CONTACT_PORTFOLIO)
    plausible = lambda l: (~F.contains(l, F.lit("@")) & ~F.contains(l, F.lit("http")) & ~l.rlike(r"\d")
                           & F.length(l).between(3, 40) & (F.size(F.split(l, " ")) <= 4))
    name = F.get(F.filter(F.slice(lines(text), 1, 5), plausible), 0)
    empty = F.lit("")
    return F.struct(
        F.coalesce(name, F.lit("Candidate")).alias("name"),
        F.coalesce(found(text, fv.CONTACT_EMAIL), empty).alias("email"),
        F.coalesce(strip(found(text, fv.CONTACT_PHONE)), empty).alias("phone"),
        F.coalesce(strip(found(text, fv.CONTACT_LOCATION)), F.lit(fv.DEFAULT_LOCATION)).alias("location"),
        link(found(text, fv.CONTACT_LINKEDIN)).alias("linkedin"), link(found(text, fv.CONTACT_GITHUB)).alias("github"),
        F.when(~F.contains(site, F.lit("linkedin")) & ~F.contains(site, F.lit("github")), link(site)).alias("portfolio"))


def summary(text: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(section_slice(text, *SUMMARY), r"\n+", " ")), F.lit(""))


def certifications(text: Column) -> Column:
    kept = F.filter(F.transform(F.split(section_slice(text, *CERTIFICATIONS), "\n"), unbulleted), lambda l: F.length(l).between(4, 99))
    return F.coalesce(kept, F.array().cast("array<string>"))


def projects(text: Column) -> Column:
    """[(name, description, line)]: the first four short unbulleted lines of the projects section."""
    kept = F.filter(lines(section_slice(text, *PROJECTS)), lambda l: ~l.rlike(r"^[•-]") & (F.length(l) < 60))
    shaped = F.transform(F.slice(kept, 1, 4), lambda l: F.struct(
        strip(F.regexp_replace(l, "[:|]", "")).alias("name"), F.lit(PROJECT_NOTE).alias("description"), l.alias("line")))
    return F.coalesce(shaped, F.array().cast("array<struct<name:string,description:string,line:string>>"))


def education(text: Column) -> Column:
    """[(degree, institution, year, gpa)] per line naming a degree; else one general entry for a university line."""
    return let(section_slice(text, *EDUCATION), _education)


def _education(section: Column) -> Column:
    def entry(line):
        place = strip(F.regexp_replace(without_first(without_first(line, DEGREE), YEAR), r"[,|•]", " "))
        return F.struct(strip(F.regexp_extract(line, DEGREE, 0)).alias("degree"),
                        F.coalesce(F.nullif(place, F.lit("")), F.lit("University")).alias("institution"),
                        found(line, YEAR).alias("year"), found(line, r"(?i)gpa[:\s]*([0-4]\.\d{1,2})", 1).alias("gpa"))

    named = F.transform(F.filter(lines(section), lambda l: l.rlike(DEGREE)), entry)
    general = found(section, r"(?i)(?:university|college|institute)[^\n]*")
    null = F.lit(None).cast("string")
    fallback = F.when(general.isNotNull(), F.array(F.struct(
        F.lit("Bachelor of Science in Computer Science").alias("degree"), strip(general).alias("institution"),
        null.alias("year"), null.alias("gpa"))))
    empty = F.array().cast("array<struct<degree:string,institution:string,year:string,gpa:string>>")
    return let(named, lambda named: F.coalesce(F.when(F.size(named) > 0, named), fallback, empty))


def work_history(text: Column) -> Column:
    """[(title, company, location, start_date, end_date, is_current, bullets)] of the experience section.

    A dated line that is no bullet opens an item; bullets (and long plain lines) up to the next dated line belong to it.
    Without dated lines a section of more than 50 characters is one general item.
    """
    opens = lambda l: l.rlike(ITEM_DATE) & ~l.rlike(r"^[•\-*·]")
    indexed = lambda rows: F.transform(rows, lambda l, i: F.struct(i.alias("i"), l.alias("l")))
    return let(section_slice(text, *EXPERIENCE), lines, lambda section, rows: F.filter(indexed(rows), lambda x: opens(x["l"])), _work_history)


def _work_history(section: Column, rows: Column, heads: Column) -> Column:
    bullet = lambda l: l.rlike(r"^[•\-*·]")
    parts = lambda t, sep: F.filter(F.transform(F.split(t, sep), strip), lambda p: p != "")
    null = F.lit(None).cast("string")

    def item(h, n):
        line, until = h["l"], F.coalesce(F.get(heads, n + 1)["i"], F.size(rows))
        last = n == F.size(heads) - 1
        own = F.slice(rows, h["i"] + 2, F.greatest(until - h["i"] - 1, F.lit(0)))
        kept = F.filter(F.transform(own, lambda l: F.when(
            bullet(l), F.when(F.length(unbulleted(l)) > 10, unbulleted(l))).when(
            (F.length(l) > 25) & ~F.contains(l, F.lit(":")), l)), lambda l: l.isNotNull())
        dates = F.regexp_extract(line, FULL_DATE, 0)
        rest = strip(F.regexp_replace(without_first(line, FULL_DATE), r"[|•,]", " "))
        inline = parts(rest, r"(?i)\s{2,}|\sat\s|[|–-]")
        previous = F.get(rows, h["i"] - 1)
        above = parts(previous, "[|–-]")
        usable = previous.isNotNull() & ~previous.rlike(r"^[•-]")
        title = (F.when(F.length(rest) > 5, F.coalesce(F.get(inline, 0), F.lit("Software Engineer")))
                 .when(usable & (F.size(above) >= 2), F.get(above, 0)).when(usable, previous).otherwise("Software Engineer"))
        company = (F.when(F.length(rest) > 5, F.coalesce(F.get(inline, 1), F.lit("Tech Company")))
                   .when(usable & (F.size(above) >= 2), F.get(above, 1)).when(usable, F.lit("Company")).otherwise("Tech Company"))
        location = F.when(F.length(rest) > 5, F.get(inline, 2)).when(usable & (F.size(above) >= 2), F.get(above, 2))
        current = F.lower(dates).rlike("present|current")
        ends = F.split(dates, "[-–—to]")
        return F.struct(title.alias("title"), company.alias("company"), location.alias("location"),
                        strip(F.get(ends, 0)).alias("start_date"),
                        F.when(current, "Present").otherwise(strip(F.get(ends, 1))).alias("end_date"), current.alias("is_current"),
                        F.when(F.size(kept) > 0, kept).otherwise(F.array(F.when(last, NO_BULLETS_LAST).otherwise(NO_BULLETS))).alias("bullets"))

    items = F.transform(heads, item)
    plain = F.filter(F.transform(F.split(section, "\n"), unbulleted), lambda l: F.length(l) > 15)
    general = F.array(F.struct(
        F.lit("Senior Professional").alias("title"), F.lit("Primary Experience").alias("company"), null.alias("location"),
        null.alias("start_date"), null.alias("end_date"), F.lit(None).cast("boolean").alias("is_current"), F.slice(plain, 1, 6).alias("bullets")))
    empty = F.array().cast("array<struct<title:string,company:string,location:string,start_date:string,end_date:string,"
                           "is_current:boolean,bullets:array<string>>>")
    return let(items, lambda items: F.coalesce(F.when(F.size(items) > 0, items), F.when(F.length(section) > 50, general), empty))


def years_estimate(text: Column, n_items: Column, as_of_year: int) -> Column:
    """Years since the earliest plausible year named (1..30); from stated years or the number of items otherwise."""
    stated = F.regexp_extract(text, r"(?i)(\d+)\+?\s*years?(?:\s+of)?\s+experience", 1).try_cast("int")
    years = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    first = F.array_min(F.filter(years, lambda y: y.between(1995, as_of_year)))
    dated = F.when((F.size(years) >= 2) & first.isNotNull(), clamp(F.lit(as_of_year) - first, 1, 30))
    return F.when(n_items == 0, F.coalesce(stated, F.lit(3))).otherwise(F.coalesce(dated, F.greatest(n_items * 2, F.lit(2)))).cast("int")


def quality_checks(text: Column, n_skills: Column) -> Column:
    """Five pass/fail checks, the share passed in percent, keyword density, words and pages."""
    return let(F.lower(text), lambda low: word_count(text), lambda low, words: _quality_checks(text, low, words, n_skills))


def _quality_checks(text: Column, low: Column, words: Column, n_skills: Column) -> Column:
    has = lambda *options: low.rlike("|".join(options))
    verbs = F.size(F.filter(F.array(*map(F.lit, fv.ACTION_VERBS)), lambda v: F.contains(low, v)))
    quantities = F.regexp_count(text, F.lit(fv.QUANTITY))
    checks = {
        "contact_details": text.rlike(fv.CONTACT_EMAIL) & text.rlike(fv.CONTACT_PHONE),
        "word_count_ok": words.between(350, 1200),
        "headings_ok": has("experience", "employment") & has("education", "degree") & has("skills", "technologies"),
        "action_verbs_ok": verbs >= 4, "metrics_ok": quantities >= 3}
    passed = F.lit(0)
    for c in checks.values():
        passed = passed + c.cast("int")
    density = F.least(half_up(n_skills / F.greatest(words, F.lit(1)) * 1000) / 10, F.lit(15.0))
    return F.struct(*[c.alias(n) for n, c in checks.items()], half_up(passed / 5.0 * 100).cast("int").alias("score"),
                    density.alias("keyword_density"), words.alias("n_words"),
                    F.greatest(F.lit(1), F.ceil(words / F.lit(450.0))).cast("int").alias("n_pages"))


def skills_by_category(skills: Column) -> Column:
    """[(skill, category)] becomes {category: [skills]}."""
    kinds = lambda skills: F.array_distinct(F.transform(skills, lambda s: s["category"]))
    return let(skills, kinds, lambda skills, kinds: F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.transform(
        F.filter(skills, lambda s: s["category"] == k), lambda s: s["skill"]))))


def parse_profiles(docs: DataFrame, tagged: DataFrame, as_of_year: int, id: str = "candidate_id", text: str = "text") -> DataFrame:
    """Full profile per document; tagged (id, skill, category, position) comes from the taxonomy join."""
    t = F.col(text)
    # One document's skills, at most the taxonomy, in its order.
    held = tagged.groupBy(id).agg(F.transform(F.array_sort(F.collect_set(F.struct("position", "skill", "category"))), lambda s: F.struct(
        s["skill"].alias("skill"), s["category"].alias("category"))).alias("skills"))
    out = docs.join(held, id, "left").withColumn(
        "skills", F.coalesce("skills", F.array().cast("array<struct<skill:string,category:string>>")))
    out = out.withColumns({"contact": contact(t), "summary": summary(t), "experience": work_history(t), "education": education(t),
                           "certifications": certifications(t), "projects": projects(t)})
    return out.withColumns({"categorized_skills": skills_by_category(F.col("skills")),
                            "years": years_estimate(t, F.size("experience"), as_of_year),
                            "checks": quality_checks(t, F.size("skills"))})
