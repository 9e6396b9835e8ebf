"""Keyword assignment to bullets and tone-keyed letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.binding import let
from pairloom.functions.text import strip, word_count

# The letter texts by tone; {company}, {role}, {skills}, {years}, {name}, {title}, {employer}, {achievement} are filled in.
GREETINGS = {"professional": "Dear Hiring Team at {company},", "enthusiastic": "Dear {company} Team,", "confident": "Dear Hiring Manager,",
             "concise": "Dear Hiring Manager,", "technical": "Dear Engineering Leadership at {company},"}
OPENINGS = {
    "professional": "I am writing to express my strong interest in the {role} position at {company}. With a comprehensive background in {skills} and a proven history of shipping high-impact software, I am excited about the opportunity to contribute to your team's ongoing innovation.",
    "enthusiastic": "I was thrilled to discover the opening for the {role} role at {company}! As someone who deeply admires your mission and technical excellence, I would be thrilled to bring my passion for {skills} to help build high-impact products.",
    "confident": "With over {years} years of high-velocity engineering experience building resilient distributed systems, I am confident that my background in {skills} aligns directly with what you are seeking in a {role} at {company}.",
    "concise": "I am applying for the {role} role at {company}. My background in {skills} directly addresses your requirements for driving dependable, scalable engineering solutions.",
    "technical": "I am submitting my candidacy for the {role} position at {company}. Having engineered scalable distributed systems leveraging {skills}, I am well-prepared to tackle your toughest technical challenges.",
}
BODIES = [
    "In my most recent role as {title} at {employer}, I {achievement}. This experience honed my ability to translate complex product requirements into robust, maintainable architecture while mentoring peer engineers.",
    "What particularly draws me to {company} is your emphasis on technical craftsmanship and delivering tangible value to end users. The challenges outlined in your {role} description—specifically regarding scalability, code reliability, and rapid iteration—are problems I have successfully navigated throughout my career.",
]
CLOSINGS = {
    "professional": "Thank you for your time and consideration. I welcome the opportunity to discuss how my technical expertise and leadership can support {company}'s goals in an interview. Sincerely, {name}.",
    "enthusiastic": "I would love the chance to connect and discuss how my energy, dedication, and technical background can add value to {company}! Sincerely, {name}.",
    "confident": "I look forward to discussing how my experience can immediately translate into measurable impact for your engineering team. Best regards, {name}.",
    "concise": "Thank you for your consideration. I look forward to connecting. Sincerely, {name}.",
    "technical": "I look forward to discussing our system design philosophies and how my skills can advance your engineering roadmap. Regards, {name}.",
}
FIELDS = ["company", "role", "skills", "years", "name", "title", "employer", "achievement"]
DEFAULTS = {"company": "your engineering organization", "role": "Software Engineer", "skills": "full-stack software development",
            "years": "4", "name": "Candidate", "title": "Software Engineer", "employer": "my previous company",
            "achievement": "spearheaded scalable cloud architecture that reduced operational overhead significantly"}


def letters(requests: DataFrame, keep: list[str]) -> DataFrame:
    """One letter per request row, which names its tone and the fields; missing fields take their defaults."""
    value = {f: F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit(DEFAULTS[f])) for f in FIELDS}
    value["achievement"] = F.concat(F.lower(F.substring(value["achievement"], 1, 1)), F.expr("substring(achievement_, 2)"))
    filled = requests.withColumn("achievement_", F.coalesce(F.nullif(F.col("achievement"), F.lit("")), F.lit(DEFAULTS["achievement"])))

    def fill(template: Column) -> Column:
        for f in FIELDS:
            template = F.replace(template, F.lit("{" + f + "}"), value[f])
        return template

    by_tone = lambda texts: F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col("tone"))
    greeting, opening, closing = (fill(by_tone(t)) for t in (GREETINGS, OPENINGS, CLOSINGS))
    blank = F.lit("")
    letter = F.concat_ws("\n", greeting, blank, opening, blank, fill(F.lit(BODIES[0])), blank, fill(F.lit(BODIES[1])), blank, closing)
    return filled.select(*keep, "tone", opening.alias("opening"), closing.alias("closing"), letter.alias("letter"))


def letter_metrics(text: Column) -> tuple[Column, Column]:
    """(words, reading minutes at 200 words a minute)."""
    words = word_count(text)
    return words, F.ceil(words / F.lit(200.0)).cast("int")


def keyword_pool(missing: Column, required: Column) -> Column:
    return F.concat(missing, required)


def assign_keywords(bullets: Column, pool: Column) -> Column:
    """[(bullet, keyword, has_metric, has_keyword, adds)] for bullets of 20 or more characters, keywords dealt in turn.

    bullets is one profile's array in page order, so the turn is the place in the filtered array.
    """
    return let(pool, lambda pool: _assign(F.filter(bullets, lambda b: F.length(b) >= 20), pool))


def _assign(kept: Column, pool: Column) -> Column:

    def deal(b, i):
        keyword = F.coalesce(F.get(pool, F.pmod(i, F.greatest(F.size(pool), F.lit(1)))), F.lit("system scalability"))
        clean = strip(F.regexp_replace(b, r"^[•\-*]\s*", ""))
        has = F.contains(F.lower(clean), F.lower(keyword))
        return F.struct(b.alias("bullet"), keyword.alias("keyword"), clean.rlike(fv.BULLET_QUANTITY).alias("has_metric"), has.alias("has_keyword"),
                        F.when(~has, F.array(keyword)).otherwise(F.array().cast("array<string>")).alias("keywords_added"))

    return F.transform(kept, deal)


def suggested_additions(missing: Column) -> Column:
    return F.slice(missing, 1, 3)
