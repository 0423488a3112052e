"""Text columns: tokens, headers, page tags, clean-up rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import fixed
from .core import TOKEN_BREAK, WHITE_SPACE, col, let, nonblank, run_end, run_starts, strip


def tokens(c: Column | str) -> Column:
    """Lower-case letter/digit runs, in order."""
    parts = F.split(F.lower(F.coalesce(col(c), F.lit(""))), TOKEN_BREAK)
    return F.filter(parts, lambda t: t != "")


def distinct_tokens(c: Column | str) -> Column:
    return F.array_distinct(tokens(c))


def token_counts(c: Column | str) -> Column:
    """``array<struct<token, tf>>`` built inside the row: no shuffle, n log n."""
    def counted(words: Column) -> Column:
        return let(run_starts(words), lambda starts: F.transform(
            starts,
            lambda start, i: F.struct(
                words[start - 1].alias("token"),
                (run_end(starts, i, F.size(words)) - start + 1).cast("bigint").alias("tf"),
            ),
        ))

    return let(F.sort_array(tokens(c)), counted)


def numbered_tokens(c: Column | str) -> Column:
    """Tokens tagged with their occurrence number, so set operations act on multisets."""
    def numbered(words: Column) -> Column:
        return let(run_starts(words), lambda starts: F.flatten(F.transform(
            starts,
            lambda start, i: F.transform(
                F.sequence(F.lit(1), run_end(starts, i, F.size(words)) - start + 1),
                lambda n: F.concat_ws("#", words[start - 1], n.cast("string")),
            ),
        )))

    return let(F.sort_array(tokens(c)), numbered)


def context_header(category: Column, entity: Column, title: Column, *,
                   no_category: str = fixed.NO_CATEGORY, no_entity: str = fixed.NO_ENTITY,
                   no_title: str = fixed.NO_TITLE) -> Column:
    """``[category - entity] title``; only *missing* parts take their default."""
    return F.format_string(
        fixed.HEADER_LAYOUT,
        F.coalesce(category, F.lit(no_category)),
        F.coalesce(entity, F.lit(no_entity)),
        F.coalesce(title, F.lit(no_title)),
    )


def contextual_chunk_text(header: Column, body: Column, *, prefix: str = fixed.CHUNK_PREFIX,
                          mark: str = fixed.CHUNK_BODY_MARK) -> Column:
    return F.concat(F.lit(prefix), header, F.lit(mark), body)


def metadata_field(metadata: str, name: str) -> Column:
    return F.coalesce(F.col(f"{metadata}.{name}").cast("string"), F.lit(""))


def integrate_sections(title: Column, date: Column, url: Column, content: Column,
                       image_text: Column, attachment_text: Column, informed: Column | None = None) -> Column:
    """Sections joined by blank lines. Image and attachment sections vanish when
    absent; the four information lines stay, empty when a value is missing, and
    vanish where ``informed`` says that there is no information file."""
    def line(label: str, value: Column) -> Column:
        text = F.concat(F.lit(label), F.coalesce(value, F.lit("")))
        return text if informed is None else F.when(informed, text)

    def section(label: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(label), value))

    return F.concat_ws(
        "\n\n",
        line("### TITLE: ", title),
        line("### DATE: ", date),
        line("### URL: ", url),
        line("### CONTENT:\n", content),
        section("### IMAGE_OCR:\n", image_text),
        section("### ATTACHMENT_TEXT:\n", attachment_text),
    )


def attachment_text(files: Column) -> Column:
    """Files ``array<struct<name, text>>`` as one text, each under its name; null without files."""
    parts = F.transform(files, lambda f: F.concat(F.lit("<"), f["name"], F.lit(">\n"), F.coalesce(f["text"], F.lit(""))))
    return F.when(F.size(files) > 0, F.array_join(parts, "\n"))


def qa_pairs(content: Column, pair: str = "struct<question:string,answer:string>") -> Column:
    """The list under ``qa_pairs`` of a JSON answer; empty where there is none or the answer is no JSON."""
    parsed = F.from_json(content, f"struct<qa_pairs:array<{pair}>>")["qa_pairs"]
    return F.coalesce(parsed, F.array().cast(f"array<{pair}>"))


def page_tag(body: Column, file_name: Column, physical_index: Column) -> Column:
    """Document id and printed page from the body, else id from the file name and
    the physical page. ``physical_index`` counts from 1."""
    found_id = F.nullif(F.regexp_extract(body, fixed.PAGE_PATTERN, 1), F.lit(""))
    found_page = F.nullif(F.regexp_extract(body, fixed.PAGE_PATTERN, 2), F.lit(""))
    file_id = F.nullif(F.regexp_extract(file_name, fixed.FILE_ID_PATTERN, 1), F.lit(""))
    return F.struct(
        F.coalesce(found_id, file_id, F.lit(fixed.UNKNOWN_DOCUMENT)).alias("doc_id"),
        F.coalesce(found_page, physical_index.cast("string")).alias("num"),
    )


def page_tag_text(tag: Column) -> Column:
    return F.concat(F.lit('<page doc_id="'), tag["doc_id"], F.lit('" num="'), tag["num"],
                    F.lit('"></page>'))


def safe_filename(c: Column | str) -> Column:
    """First line, reserved characters replaced."""
    first = F.trim(F.element_at(F.split(col(c), "\n"), 1))
    return F.regexp_replace(first, r'[\\/:*?"<>|]', "_")


def complete_date(c: Column | str, year: int | Column) -> Column:
    """``MM-DD`` gets the given year; unreadable dates become null."""
    text = col(c)
    prefix = year.cast("string") if isinstance(year, Column) else F.lit(str(year))
    full = F.when(F.length(text) <= 5, F.concat(prefix, F.lit("-"), text)).otherwise(text)
    return F.try_to_date(full, "yyyy-MM-dd")


def truncate_text(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def preview(c: Column | str, n: int = 150) -> Column:
    return F.substring(F.replace(col(c), F.lit("\n"), F.lit(" ")), 1, n)


def source_to_notice_id(source: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(source), fixed.SOURCE_ID_PATTERN, 1), F.lit(""))


def source_to_pdf(source: Column | str) -> Column:
    """PDF file name of a markdown source, else null."""
    name = F.element_at(F.split(col(source), "/"), -1)
    return F.when(col(source).endswith(".md"), F.replace(name, F.lit(".md"), F.lit(".pdf")))


def strip_wrappers(c: Column | str) -> Column:
    """Drop code fences, then one pair of enclosing double quotes."""
    unfenced = strip(F.regexp_replace(col(c), r"(?m)^```[A-Za-z]*[ \t]*$|```", ""))
    quoted = (F.length(unfenced) >= 2) & unfenced.startswith('"') & unfenced.endswith('"')
    return F.when(quoted, F.substr(unfenced, F.lit(2), F.length(unfenced) - 2)).otherwise(unfenced)


def strip_instruction(c: Column | str, marker: str, preamble: str) -> Column:
    """Text before ``marker``, without the preamble."""
    return strip(F.replace(F.substring_index(col(c), marker, 1), F.lit(preamble), F.lit("")))


def ensure_suffix(c: Column | str, suffix: str) -> Column:
    """Append ``suffix`` unless the text already holds its stripped form."""
    text = col(c)
    tail = F.rtrim(text, F.lit(WHITE_SPACE))
    return F.when(text.contains(suffix.strip()), text).otherwise(F.concat(tail, F.lit(suffix)))


def turn_template(user: Column, model: Column | None = None, *,
                  layout: Sequence[str] = ("<start_of_turn>", "<end_of_turn>")) -> Column:
    """Flat turn-marked text; without ``model`` it ends in the open model turn."""
    begin, end = layout
    opening = F.concat(F.lit(f"{begin}user\n"), user, F.lit(f"{end}\n{begin}model\n"))
    return opening if model is None else F.concat(opening, model, F.lit(end))


def chat_messages(user: Column, model: Column) -> Column:
    return F.array(
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("model").alias("role"), model.alias("content")),
    )


def instruction_text(instruction: Column, question: Column) -> Column:
    return F.concat(instruction, F.lit("\n"), question)


def inject_cue(question: Column, pick: Column, cues: Sequence[str]) -> Column:
    """Add the ``pick``-th cue (0-based, wraps). Cues starting with a blank or ``(``
    are suffixes and go before a closing question mark; the others are prefixes."""
    text = strip(question)
    chosen = F.element_at(F.array(*[F.lit(c) for c in cues]),
                          (F.pmod(pick, F.lit(len(cues))) + 1).cast("int"))
    suffixed = F.when(
        text.endswith("?"),
        F.concat(F.substr(text, F.lit(1), F.length(text) - 1), chosen, F.lit("?")),
    ).otherwise(F.concat(text, chosen))
    is_suffix = chosen.startswith(" ") | chosen.startswith("(")
    return F.when(is_suffix, suffixed).otherwise(F.concat(chosen, text))


def hash_pick(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def first_ground_truth(*fields: Column, sentinel: str = fixed.NO_ANSWER) -> Column:
    """First field that is neither blank nor the no-answer sentinel, else ``""``."""
    usable = [F.nullif(nonblank(f), F.lit(sentinel)) for f in fields]
    return F.coalesce(*usable, F.lit(""))


def fixed_decimals(c: Column, digits: int) -> Column:
    """Fixed number of decimals, rounding the exact binary value half to even.

    ``format_string`` rounds the shortest decimal spelling instead, so 0.0525
    (slightly below in binary) would go up. The scaled value is kept as a
    product and its exact error term (Dekker's splitting).
    """
    scale, splitter = float(10 ** digits), 134217729.0

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * splitter - (x * splitter - x)
        return high, x - high

    def text(x: Column) -> Column:
        product = x * F.lit(scale)
        (xh, xl), (sh, sl) = halves(x), halves(F.lit(scale))
        error = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
        whole = F.floor(product)
        rest = product - whole
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        number = whole + F.when(up, 1).otherwise(0)
        unit = F.lit(10 ** digits)
        return F.format_string(f"%d.%0{digits}d", F.floor(number / unit), number % unit)

    value = c.cast("double")
    return F.concat(F.when(value < 0, "-").otherwise(""), let(F.abs(value), text))


def format_metric(c: Column, digits: int = 3) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(fixed_decimals(c, digits))
