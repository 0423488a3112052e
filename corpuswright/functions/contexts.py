"""Context lists, source labels, page windows and prompt blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from .core import col, nonblank, strip


def source_label(category: Column, parent: Column, layout: str, *, empty_is_missing: bool,
                 default: str = fixed.GENERAL_CATEGORY) -> Column:
    """Category label of a hit. The merged search defaults only a missing category,
    the node search also an empty one."""
    named = F.nullif(category, F.lit("")) if empty_is_missing else category
    return F.format_string(layout, F.coalesce(named, F.lit(default)),
                           F.coalesce(parent, F.lit(fixed.UNKNOWN_DOCUMENT)))


def clean_list(items: Column) -> Column:
    """Strip every entry and drop the blank ones; null becomes an empty list."""
    stripped = F.transform(items, lambda x: strip(x))
    return F.coalesce(F.filter(stripped, lambda x: x.isNotNull() & (x != "")),
                      F.array().cast("array<string>"))


def as_list(scalar: Column) -> Column:
    return clean_list(F.array(scalar))


def contexts_as_list(chunk_texts: Column, labels: Column) -> Column:
    """Chunk texts when there are any, else the labels."""
    texts, names = clean_list(chunk_texts), clean_list(labels)
    return F.when(F.size(texts) > 0, texts).otherwise(names)


def label_only_contexts(contexts: Column, min_chars: int = fixed.LABEL_CONTEXT_LENGTH) -> Column:
    """True when nothing is long enough to be a chunk text."""
    return F.coalesce(
        F.forall(contexts, lambda x: F.length(strip(x)) < min_chars), F.lit(True)
    )


def page_window(page: Column, cap: int = fixed.MEDIA_CAP) -> Column:
    """The page and its neighbours; without a page, the default list for the cap."""
    return F.when(
        page.isNotNull() & (page > 0),
        F.sort_array(F.array_distinct(F.array(page, F.greatest(F.lit(1), page - 1), page + 1))),
    ).otherwise(default_pages(cap))


def default_pages(cap: int) -> Column:
    last = 1 if cap <= 4 else 2 if cap <= 10 else 3
    return F.array(*[F.lit(n) for n in range(1, last + 1)])


def block_merged(position: Column, source: Column, page: Column, text: Column) -> Column:
    return F.concat(
        F.format_string("[참고 문서 %d]\n", position),
        F.format_string("- 출처: %s (페이지: %s)\n", source, page.cast("string")),
        F.concat(F.lit("- 내용: "), text, F.lit("\n\n")),
    )


def block_ranked(position: Column, year: Column, entity: Column, category: Column, text: Column) -> Column:
    return F.concat(
        F.format_string("[문서 중요도 순위: %d위]\n", position),
        F.format_string("- 작성연도: %s년\n- 담당부서: %s\n- 분류: %s\n", year, entity, category),
        F.lit("- 본문 내용:\n"), text,
    )


def block_node(position: Column, source: Column, text: Column) -> Column:
    return F.concat(F.format_string("\n### 문서 조각 %d [출처: %s] ###\n", position, source),
                    text, F.lit("\n"))


def block_paged(position: Column, source: Column, page: Column, text: Column) -> Column:
    return F.concat(F.format_string("문서 %d:\n[출처: %s | 페이지: %s]\n", position, source,
                                    page.cast("string")), text, F.lit("\n\n"))


def block_bullet(source: Column, page: Column, text: Column) -> Column:
    return F.concat(F.format_string("- %s (p.%s): ", source, page.cast("string")), text)


def block_year(year: Column, entity: Column, text: Column) -> Column:
    return F.concat(F.format_string("[문서 출처: %s년 %s]\n", F.coalesce(year, F.lit("")), F.coalesce(entity, F.lit(""))),
                    F.coalesce(text, F.lit("")))


def framed(context: Column) -> Column:
    """The ranked layout's rules above and below."""
    rule = F.lit(f"\n\n{fixed.CONTEXT_RULE}")
    return F.concat(rule, context, rule)


# Block layouts, each with the separator placed between blocks.
LAYOUT_SEPARATORS = {"merged": "", "ranked": "\n\n", "node": "", "paged": "", "bullet": "\n",
                     "year": fixed.YEAR_BLOCK_SEPARATOR}


def build_prompt(context: Column, question: Column, *, context_title: str = "",
                 question_title: str = "\n\n[사용자 질문]\n") -> Column:
    return F.concat(F.lit(context_title), context, F.lit(question_title), question)


def source_footer(answer: Column, sources: Column, *, mark: str = fixed.SOURCES_MARK,
                  title: str = "📚 **[참고 문헌 및 근거 자료]**") -> Column:
    """Append the distinct sources, sorted, unless the answer already cites them."""
    lines = F.array_join(
        F.transform(F.sort_array(F.array_distinct(sources)), lambda s: F.concat(F.lit("- "), s)), "\n"
    )
    return F.when(answer.contains(mark), answer).otherwise(
        F.concat(answer, F.lit(f"\n\n{title}\n"), lines)
    )


def vision_footer(answer: Column, pages: Column, with_images: Column) -> Column:
    """Append the pages that were shown, in their order, or the line that says there were none."""
    title = F.when(with_images, F.lit(fixed.PAGES_TITLE)).otherwise(F.lit(fixed.NO_PAGES_TITLE))
    lines = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("- "), p)), "\n")
    listed = F.when(F.coalesce(F.size(pages), F.lit(0)) > 0, lines).otherwise(F.lit(fixed.NO_PAGES_LINE))
    return F.concat(answer, title, listed)


def fill_answer(answer: Column, other_answer: Column) -> Column:
    return F.coalesce(F.nullif(F.coalesce(answer, other_answer), F.lit("")), F.lit(fixed.EMPTY_ANSWER))


def fill_contexts(contexts: Column, other_contexts: Column) -> Column:
    given = F.coalesce(contexts, other_contexts)
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(
        F.array(F.lit(fixed.EMPTY_CONTEXT)))


def fill_truth(truth: Column) -> Column:
    return F.coalesce(F.nullif(col(truth), F.lit("")), F.lit(fixed.EMPTY_TRUTH))


__all__ = [name for name in dir() if not name.startswith("_") and name not in ("annotations", "nonblank")]
