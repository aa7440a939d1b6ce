"""Model-answer parsing (X11, X12, X15): answer text -> array of result structs.

Rules, in order:
  1. the whole text is JSON: an array is the result list; an object gives the
     first of the wrapper keys holding an array, else its first array value in
     document order; anything else gives no results;
  2. otherwise the first fenced part that is a JSON array (the name of a language
     after the fence is left out; a fence that is not closed fences nothing);
  3. otherwise the span from the first '[' to the last ']' if it is an array;
  4. otherwise no results (an empty array; NULL answer -> NULL).

Everything is a JVM-side expression (``try_parse_json``/``from_json``); the
shape is tested before ``from_json`` so a lone object is never wrapped into a
one-element array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bracketed(text: Column) -> Column:
    """From the first opening to the last closing bracket."""
    first = F.instr(text, "[")
    last = F.length(text) - F.instr(F.reverse(text), "]") + 1
    return F.when((first > 0) & text.contains("]") & (last > first), F.substring(text, first, last - first + 1))


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _first_char(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1)


def _array_text(text: Column) -> Column:
    """``text`` when it parses as a JSON array, else NULL."""
    return F.when(_is_json(text) & (_first_char(text) == "["), text)


def _fenced(text: Column) -> Column:
    """The first array among the parts between fences: every second part of the text cut at its fences."""
    parts = F.split(text, "`{3}")
    inside = F.filter(parts, lambda _, i: (i % 2 == 1) & (i < F.size(parts) - 1))
    arrays = F.transform(inside, lambda p: _array_text(F.trim(F.regexp_replace(p, r"^\w+\s", ""))))
    return F.try_element_at(F.filter(arrays, lambda a: a.isNotNull()), F.lit(1))


def result_list_text(answer: Column, wrapper_keys: tuple[str, ...]) -> Column:
    """The JSON text of the result array an answer holds, or NULL (no results)."""
    whole_ok = _is_json(answer)
    first = _first_char(answer)
    v = F.try_parse_json(answer)
    wrapped = [F.when(F.substring(F.ltrim(F.to_json(F.try_variant_get(v, F.lit(f"$.{k}"),
                                                                      "variant"))), 1, 1) == "[",
                      F.to_json(F.try_variant_get(v, F.lit(f"$.{k}"), "variant")))
               for k in wrapper_keys]
    # first array value in document order: a map keeps the object's entry order
    entries = F.map_values(F.from_json(answer, T.MapType(T.StringType(), T.StringType())))
    first_list = F.try_element_at(F.filter(entries, lambda x: (_first_char(x) == "[") & _is_json(x)),
                                  F.lit(1))
    obj = F.coalesce(*wrapped, first_list)
    from_whole = (F.when(first == "[", answer)
                  .when(first == "{", obj))
    brackets = _array_text(_bracketed(answer))
    return F.when(answer.isNull(), F.lit(None)) \
        .when(whole_ok, from_whole) \
        .otherwise(F.coalesce(_fenced(answer), brackets))


def parse_results(answer: Column, schema: T.StructType, wrapper_keys: tuple[str, ...]) -> Column:
    """array<schema> of the results in an answer; [] when it holds none."""
    txt = result_list_text(answer, wrapper_keys)
    arr = F.from_json(txt, T.ArrayType(schema))
    return F.when(answer.isNull(), F.lit(None)).otherwise(
        F.coalesce(F.filter(arr, lambda x: x.isNotNull()), F.array().cast(T.ArrayType(schema))))


def keywords_from_text(text: Column) -> Column:
    """X15 decode: stored keyword text -> array; accepts a JSON array or a JSON
    string holding one (double encoding); anything else -> []."""
    arr_t = T.ArrayType(T.StringType())
    once = F.from_json(F.when(_first_char(text) == "[", text), arr_t)
    inner = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    twice = F.from_json(F.when((_first_char(text) == '"') & (_first_char(inner) == "["), inner), arr_t)
    return F.coalesce(once, twice, F.array().cast(arr_t))


def keywords_to_text(arr: Column) -> Column:
    """X15 encode (single JSON encoding; NULL -> '[]')."""
    return F.coalesce(F.to_json(arr), F.lit("[]"))
