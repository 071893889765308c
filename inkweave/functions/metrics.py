"""Quality metrics of an output text. Each is a double between 0 and 1, or null where it has no basis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweave.functions.text import filled_lines, words


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def diversity(tokens: Column) -> Column:
    """Distinct words over all words."""
    return _share(F.size(F.array_distinct(tokens)), F.size(tokens))


def coherence(lines: Column) -> Column:
    """Distinct lines over all lines; of lines as ``filled_lines`` gives them."""
    return _share(F.size(F.array_distinct(lines)), F.size(lines))


def relevance(input_tokens: Column, output_tokens: Column) -> Column:
    """Share of the output's distinct words that the input holds too."""
    distinct = F.array_distinct(output_tokens)
    return _share(F.size(F.array_intersect(distinct, input_tokens)), F.size(distinct))


def word_share(tokens: Column, listed: Sequence[str]) -> Column:
    """Share of the words that are in the given list (compared in lower case)."""
    wanted = sorted({word.lower() for word in listed})
    if not wanted:
        return _share(F.lit(0), F.size(tokens))
    return _share(F.size(F.filter(tokens, lambda t: t.isin(*wanted))), F.size(tokens))


def toxicity(tokens: Column, listed: Sequence[str], label: Column | None = None) -> Column:
    """The given label (0 or 1) where there is one, else the share of listed words."""
    share = word_share(tokens, listed)
    return share if label is None else F.coalesce(label.cast("double"), share)


def bias(tokens: Column, listed: Sequence[str]) -> Column:
    return word_share(tokens, listed)


__all__ = ["bias", "coherence", "diversity", "filled_lines", "relevance", "toxicity", "word_share", "words"]
