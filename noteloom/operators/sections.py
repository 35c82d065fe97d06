"""Sections of a lecture with their cues, slides, audio cuts, prompts and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import scalars as s
from noteloom.operators.search import index, sent
from noteloom.sources.shared import settled

LIST_ROWS = 100_000  # sections of a term that one task may hold
SLACK = 1e-6  # similarities are rounded to six digits

# The note's link texts and the placeholder of a section without cues.
AUDIO_LINK = "Аудио"
SLIDE_LINK = "Слайд"
EMPTY_FRAGMENT = "[пустой фрагмент]"


def cue_section_join(cues: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections with each cue that touches them, both ends closed; a section without cues stays, with null cue_no.

    Equi-join on the lecture with the interval as a residual condition.
    """
    c = cues.select(F.col("lecture_id").alias("of"), F.col("caption_no").alias("cue_no"), F.col("start_s").alias("cue_start"), F.col("end_s").alias("cue_end"), F.col("text").alias("cue_text"))
    touch = (F.col("lecture_id") == F.col("of")) & (F.col("cue_end") >= F.col("start_s")) & (F.col("cue_start") <= F.col("end_s"))
    return sections.join(c, touch, "left").drop("of")


def interval_join_bucketed(a: DataFrame, b: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of rows of one key whose closed intervals [lo, hi] touch, for keys with long streams.

    Both sides are dealt to buckets of `width`; a pair counts in the first bucket that both have, so no
    distinct is needed. Inverted intervals touch nothing. Columns of b get the suffix _b.
    """
    slots = lambda: F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))
    left = a.filter("lo <= hi").withColumn("slot", slots())
    right = b.filter("lo <= hi").withColumn("slot", slots())
    right = right.select(F.col(key), "slot", *(F.col(c).alias(f"{c}_b") for c in b.columns if c != key))
    first = F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("lo_b") / width))
    return left.join(right, [key, "slot"]).filter((F.col("hi") >= F.col("lo_b")) & (F.col("lo") <= F.col("hi_b")) & (F.col("slot") == first)).drop("slot")


def section_slide_join(sections: DataFrame, slide_map: DataFrame, slides: DataFrame) -> DataFrame:
    """Sections with their slides in the order of the map; numbers beyond the deck keep a null path, sections without a map entry a null number."""
    return sections.join(slide_map, ["lecture_id", "section_no"], "left").join(slides, ["lecture_id", "slide_no"], "left")


def slide_valid(slide_map: DataFrame, slides: DataFrame) -> DataFrame:
    """Map entries whose slide exists."""
    return slide_map.join(slides.select("lecture_id", "slide_no"), ["lecture_id", "slide_no"], "left_semi")


def section_audio_join(sections: DataFrame, audio: DataFrame) -> DataFrame:
    """Sections and audio cuts by number; a section without a cut has a null path, a cut without a section a made-up title."""
    joined = sections.join(audio, ["lecture_id", "section_no"], "full_outer")
    return joined.withColumn("title", F.coalesce("title", F.concat(F.lit("section-"), (F.col("section_no") + 1).cast("string"))))


def titled(sections: DataFrame) -> DataFrame:
    """Sections with title, start_tc, end_tc."""
    number = (F.col("section_no") + 1).cast("string")
    return sections.withColumns({"title": F.concat(F.lit("Section "), number), "start_tc": s.format_tc(F.col("start_s")), "end_tc": s.format_tc(F.col("end_s"))})


def fragment_assemble(joined: DataFrame) -> DataFrame:
    """fragment of each section: its cues' SRT blocks in order, parted by blank lines; empty without cues.

    joined: cue_section_join of cues with `cue_text`.
    """
    block = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), s.format_tc(F.col("cue_start")), F.lit(" --> "), s.format_tc(F.col("cue_end")), F.lit("\n"), F.col("cue_text"))
    whole = F.expr("listagg(block, '\n\n') WITHIN GROUP (ORDER BY cue_no)")
    return joined.withColumn("block", block).groupBy("lecture_id", "section_no").agg(F.coalesce(whole, F.lit("")).alias("fragment"))


def empty_fragment(fragments: DataFrame) -> DataFrame:
    """note: the placeholder where the fragment is empty; prompted: whether the section goes to the model."""
    empty = F.col("fragment") == ""
    return fragments.withColumns({"note": F.when(empty, EMPTY_FRAGMENT), "prompted": ~empty})


def fill(template: Column, holes: dict[str, Column]) -> Column:
    for name, value in holes.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def prompt_build(sections: DataFrame, template: DataFrame) -> DataFrame:
    """prompt of each section: the one-row template with its holes filled, then the fragment. The template is broadcast."""
    filled = fill(F.col("body"), {k: F.col(v) for k, v in (("title", "title"), ("start", "start_tc"), ("end", "end_tc"))})
    return sections.crossJoin(F.broadcast(template)).select("lecture_id", "section_no", F.concat(filled, F.lit("\n"), "fragment").alias("prompt"))


def slide_prompt(sections: DataFrame, body: str) -> DataFrame:
    """prompt of each lecture: the sections as a JSON array after the body."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("section_no", "title", "start_tc", "end_tc"))), lambda x: F.struct(x["title"].alias("title"), x["start_tc"].alias("start"), x["end_tc"].alias("end")))
    return sections.groupBy("lecture_id").agg(F.concat(F.lit(body + "\n"), F.to_json(rows)).alias("prompt"))


def note_sections(sections: DataFrame, slide_rows: DataFrame) -> DataFrame:
    """part: one section's Markdown. sections: title, start_tc, end_tc, content, audio_path; slide_rows: section_slide_join."""
    link = F.concat(F.lit(f"![{SLIDE_LINK} "), F.col("slide_no").cast("string"), F.lit("]("), F.col("path"), F.lit(")"))
    links = slide_rows.filter("path IS NOT NULL").withColumn("link", link).groupBy("lecture_id", "section_no").agg(
        F.expr("listagg(concat(link, '\n\n'), '') WITHIN GROUP (ORDER BY ord)").alias("links")
    )
    times = F.concat(F.lit("["), F.col("start_tc"), F.lit(" - "), F.col("end_tc"), F.lit("]"))
    audio = F.when(F.col("audio_path").isNotNull(), F.concat(F.lit(f" | [{AUDIO_LINK}]("), F.col("audio_path"), F.lit(")"))).otherwise("")
    part = F.concat(F.lit("## "), "title", F.lit("\n"), times, audio, F.lit("\n\n"), F.coalesce("links", F.lit("")), s.strip(F.col("content")), F.lit("\n"))
    return sections.join(links, ["lecture_id", "section_no"], "left").withColumn("part", part)


def note_assemble(parts: DataFrame) -> DataFrame:
    """note_md of each lecture: the sections in order, trimmed, with a final line end."""
    whole = F.expr("listagg(part, '\n') WITHIN GROUP (ORDER BY section_no)")
    return parts.groupBy("lecture_id").agg(F.concat(s.strip(whole), F.lit("\n")).alias("note_md"))


def script_note(parts: DataFrame, heading: str = "Конспект лекции") -> DataFrame:
    """The other form of a note: a heading, sections with truncated times, parted by rules. parts: title, start_tc, end_tc, content."""
    times = F.concat(F.lit("["), s.trunc_tc(F.col("start_tc")), F.lit(" - "), s.trunc_tc(F.col("end_tc")), F.lit("]"))
    part = F.concat(F.lit("## "), "title", F.lit("\n"), times, F.lit("\n\n"), "content", F.lit("\n"))
    whole = F.expr("listagg(part, '\n---\n\n') WITHIN GROUP (ORDER BY section_no)")
    return parts.withColumn("part", part).groupBy("lecture_id").agg(F.concat(F.lit(f"# {heading}\n\n"), whole).alias("note_md"))


def compression_stats(sections: DataFrame, notes: DataFrame) -> DataFrame:
    """Characters of plain source text and of the result, their ratio in per cent, and whether it is under 70.

    One row per section and, with a null section_no, one per lecture; the lecture's result is the whole note.
    sections: lecture_id, section_no, fragment, content; notes: lecture_id, note_md.
    """
    rows = sections.select("lecture_id", "section_no", F.length(s.plain_text(F.col("fragment"))).alias("plain"), F.length("content").alias("result"))
    sums = rows.groupingSets([("lecture_id", "section_no"), ("lecture_id",)], "lecture_id", "section_no").agg(
        F.sum("plain").alias("plain_chars"), F.sum("result").alias("section_chars"), F.grouping("section_no").alias("whole")
    )
    out = sums.join(notes.select("lecture_id", F.length("note_md").cast("long").alias("note_chars")), "lecture_id")
    result = F.when(F.col("whole") == 1, F.col("note_chars")).otherwise(F.col("section_chars"))
    ratio = s.safe_div(F.col("result_chars"), F.col("plain_chars")) * 100
    return out.withColumn("result_chars", result).select("lecture_id", "section_no", "plain_chars", "result_chars", ratio.alias("ratio_pct"), (ratio < 70).alias("short"))


def section_gap(sections: DataFrame) -> DataFrame:
    """gap_s to the previous section of the lecture (negative: overlap), and whether the section is inverted."""
    w = Window.partitionBy("lecture_id").orderBy("section_no")
    return sections.select("lecture_id", "section_no", (F.col("start_s") - F.lag("end_s").over(w)).alias("gap_s"), (F.col("end_s") < F.col("start_s")).alias("inverted"))


def note_audit(sections: DataFrame, marker: str = "[?") -> DataFrame:
    """(lecture_id, section_no, rule, passed, value) for the rules of a section: at most 300 s long, in
    chronological order, some cues, result of 85 to 100 per cent of the source's words, unclear markers,
    a heading with a time line. sections: start_s, end_s, n_cues, source_words, note_words, part."""
    w = Window.partitionBy("lecture_id").orderBy("section_no")
    long = F.col("end_s") - F.col("start_s")
    share = s.safe_div(F.col("note_words"), F.col("source_words")) * 100
    marks = ((F.length("part") - F.length(F.replace("part", F.lit(marker), F.lit("")))) / len(marker)).cast("double")
    head = F.col("part").rlike(r"(?m)^## .+\n\[\d{2,}:\d{2}:\d{2}")
    back = F.coalesce(F.col("start_s") - F.lag("start_s").over(w), F.lit(0.0))
    rules = [("length", long <= 300, long), ("order", back >= 0, back), ("cues", F.col("n_cues") > 0, F.col("n_cues").cast("double")),
             ("volume", share.between(85, 100), share), ("unclear", marks == 0, marks), ("heading", head, head.cast("double"))]
    cells = F.array(*(F.struct(F.lit(n).alias("rule"), p.alias("passed"), v.alias("value")) for n, p, v in rules))
    return sections.withColumn("cells", cells).select("lecture_id", "section_no", F.inline("cells"))


def bundle_manifest(sections: DataFrame, audio: DataFrame, slides: DataFrame) -> DataFrame:
    """(lecture_id, path) of every file of a lecture's bundle: audio cuts, slides, the note."""
    cuts = section_audio_join(sections, audio).filter("audio_path IS NOT NULL")
    cuts = cuts.select("lecture_id", F.concat(F.lit("audio/"), s.audio_name(F.col("section_no") + 1, F.col("title"))).alias("path"))
    deck = slides.select("lecture_id", F.concat(F.lit("slides/"), s.slide_name(F.col("slide_no"))).alias("path"))
    note = sections.select("lecture_id").distinct().select("lecture_id", F.lit("конспект.md").alias("path"))
    return cuts.unionByName(deck).unionByName(note)


def weighted_terms(sections: DataFrame, slides: DataFrame, most_df: float = 0.2, least: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """TF-IDF terms of both sides, stored: (section_id, term, w, n1, late) of the slides' terms, and (slide_id, term, w, n2). Terms of more than `most_df` of the
    sections are dropped. late: the commonest terms of a section that together can't reach `least` with any slide."""
    known = index(sections.select(F.col("section_id").alias("doc_id"), "text"))
    idf = known.terms.filter(F.col("df") <= F.col("n_all") * most_df)
    right = slides.select("slide_id", F.explode(s.tokens(F.col("text"))).alias("term")).groupBy("slide_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    right = right.join(idf.withColumnRenamed("token", "term"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    square = F.col("w") * F.col("w")
    right = settled(right.select("slide_id", "term", "w", F.sqrt(F.sum(square).over(Window.partitionBy("slide_id"))).alias("n2")), "slides")
    # a section's terms are together in its block, so what follows needs no further shuffle
    rows = known.postings.drop("most").join(idf, "token").repartition(known.parts, "block").select("block", F.col("token").alias("term"), "df", "idf", F.inline("hits"))
    rows = rows.select("block", F.col("doc_id").alias("section_id"), "term", "df", (F.col("tf") * F.col("idf")).alias("w"))
    own = Window.partitionBy("block", "section_id")
    common = own.orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    size = F.sqrt(F.sum(square).over(own))
    left = rows.withColumns({"n1": size, "late": F.sqrt(F.sum(square).over(common)) < size * (least - SLACK)})
    left = left.join(sent(right.select("term").distinct(), "slide-terms"), "term", "left_semi")  # the others only count in n1
    return settled(left.select("section_id", "term", "w", "n1", "late"), "sections"), right


def term_pairs(left: DataFrame, right: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(section_id, slide_id, n1, n2, w1, w2) for each term that isn't late in the section. A list of more than `list_rows` sections is
    dealt to several tasks, each with the term's slides."""
    posts = left.filter(~F.col("late")).select("section_id", "term", F.col("w").alias("w1"), "n1")
    long = posts.groupBy("term").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > list_rows).select("term", F.ceil(F.col("m") / list_rows).cast("int").alias("salts"))
    long = settled(long, "long-lists")
    posts = posts.join(long, "term", "left").withColumn("salt", F.pmod(F.xxhash64("section_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    lists = right.select("slide_id", "term", F.col("w").alias("w2"), "n2").join(long, "term", "left")
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return posts.join(lists, ["term", "salt"]).drop("term", "salt")


def slide_match_text(sections: DataFrame, slides: DataFrame, most_df: float = 0.2, least: float = 0.05, top: int = 3, list_rows: int = LIST_ROWS) -> DataFrame:
    """(section_id, slide_id, sim, rank): the best `top` slides of a section by TF-IDF cosine of at least `least`.

    Sections and slides meet by the section's rarer terms only: its commonest terms, as many as can't reach `least` together, are added for
    the pairs that still can. sections: section_id, text; slides: slide_id, text (the smaller side).
    """
    left, right = weighted_terms(sections, slides, most_df, least)
    met = term_pairs(left, right, list_rows).groupBy("section_id", "slide_id").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    rest = left.filter("late").groupBy("section_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rest"))
    can = F.col("dot") + F.coalesce("rest", F.lit(0.0)) * F.col("n2") >= F.col("n1") * F.col("n2") * (least - SLACK)
    met = settled(met.join(rest, "section_id", "left").filter(can).drop("rest"), "met")
    late = left.filter("late").select("section_id", "term", F.col("w").alias("w1"))
    more = met.select("section_id", "slide_id").join(late, "section_id").join(right.select("slide_id", "term", F.col("w").alias("w2")), ["slide_id", "term"])
    more = more.groupBy("section_id", "slide_id").agg(F.sum(F.col("w1") * F.col("w2")).alias("more"))
    dot = F.col("dot") + F.coalesce("more", F.lit(0.0))
    sims = met.join(more, ["section_id", "slide_id"], "left").select("section_id", "slide_id", F.round(dot / (F.col("n1") * F.col("n2")), 6).alias("sim")).filter(F.col("sim") >= least)
    rank = F.row_number().over(Window.partitionBy("section_id").orderBy(F.desc("sim"), "slide_id"))
    return sims.withColumn("rank", rank).filter(F.col("rank") <= top)
