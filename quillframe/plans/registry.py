"""The feature registry: what is measured, how it pools and how it compares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Feature, geometry, reducer, metric, top code, runtime-sensitive, support unit.
_FEATURES = """
text.sample.byte_count int SUM NONE - - artifact
text.sample.character_count int SUM NONE - y artifact
text.surface.line_ending cat CAT JSD2 - - line break
text.surface.whitespace_class cat CAT JSD2 - - whitespace code point
text.surface.unicode_general_category cat CAT JSD2 - y character
text.surface.letter_case cat CAT JSD2 - - Unicode letter
text.surface.punctuation_codepoint cat CAT JSD2 - - punctuation code point
text.surface.marker_style cat CAT JSD2 - - marker event
text.lexical.word_count int SUM NONE - - artifact
text.lexical.number_count int SUM NONE - - artifact
text.lexical.token_kind cat CAT JSD2 - - lexical token
text.lexical.word_length hist HIST W1 31 - word
text.lexical.type_count_casefold int SAMPLE NONE - y word
text.lexical.ttr_casefold ratio SAMPLE ABS - y word
text.lexical.hapax_type_count_casefold int SAMPLE NONE - y word
text.lexical.hapax_token_share_casefold ratio SAMPLE ABS - y word
text.lexical.window_ttr_100 summary NONE NONE - y 100-word window
text.lexical.word_entropy_bits_casefold float SAMPLE NONE - - word
text.lexical.word_simpson_concentration_casefold float SAMPLE ABS - - word
text.structure.sentence_count int SUM NONE - - artifact
text.structure.sentence_length_tokens hist HIST W1 101 - sentence
text.structure.sentence_length_characters hist HIST W1 501 - sentence
text.structure.paragraph_count int SUM NONE - - artifact
text.structure.paragraph_sentence_count hist HIST W1 51 - paragraph
text.structure.paragraph_token_count hist HIST W1 501 - paragraph
text.function_words.en.token_share ratio RATIO ABS - - word
text.function_words.en.lexeme_distribution cat CAT JSD2 - - matched function word
code.sample.byte_count int SUM NONE - - artifact
code.sample.character_count int SUM NONE - - artifact
code.sample.physical_line_count int SUM NONE - - artifact
code.surface.line_ending cat CAT JSD2 - - line break
code.surface.whitespace_class cat CAT JSD2 - - whitespace code point
code.surface.indent_kind cat CAT JSD2 - - nonblank line
code.surface.indent_char_count hist HIST W1 33 - nonblank line
code.surface.nonblank_line_length hist HIST W1 201 - nonblank line
code.surface.blank_line_share ratio RATIO ABS - - physical line
code.surface.blank_run_length hist HIST W1 11 - blank run
code.surface.trailing_space_line_share ratio RATIO ABS - - physical line
code.python.lexical.token_class cat CAT JSD2 - y token
code.python.lexical.keyword_distribution cat CAT JSD2 - y token
code.python.lexical.operator_distribution cat CAT JSD2 - - token
code.python.lexical.number_form cat CAT JSD2 - - token
code.python.lexical.string_quote cat CAT JSD2 - y string token
code.python.lexical.string_prefix cat CAT JSD2 - y string token
code.python.naming.identifier_occurrence_length hist HIST W1 65 - identifier occurrence
code.python.naming.identifier_occurrence_case_style cat CAT JSD2 - - identifier occurrence
code.python.naming.binding_role cat CAT JSD2 - - binding event
code.python.naming.binding_length hist HIST W1 65 - binding event
code.python.naming.binding_case_style cat CAT JSD2 - - binding event
code.python.naming.binding_component_length hist HIST W1 33 - binding event
code.python.naming.attribute_name_length hist HIST W1 65 - attribute occurrence
code.python.naming.attribute_case_style cat CAT JSD2 - - attribute occurrence
code.python.syntax.node_distribution cat CAT JSD2 - y ast node
code.python.syntax.parent_child_distribution cat CAT JSD2 - y ast node edge
code.python.syntax.node_depth hist HIST W1 26 y ast node
code.python.structure.function_count int SUM NONE - - artifact
code.python.structure.class_count int SUM NONE - - artifact
code.python.structure.function_kind cat CAT JSD2 - - function
code.python.structure.function_length_lines hist HIST W1 201 - function
code.python.structure.parameter_count hist HIST W1 21 - function
code.python.structure.return_count hist HIST W1 11 - function
code.python.structure.nonterminal_return_function_share ratio RATIO ABS - - function
code.python.structure.control_construct cat CAT JSD2 - - control construct
code.python.structure.max_control_nesting hist HIST W1 11 - function
code.python.structure.branch_construct_count hist HIST W1 21 - function
code.python.structure.decorator_count hist HIST W1 11 - decorated definition
code.python.structure.assignment_kind cat CAT JSD2 - - assignment
code.python.structure.import_kind cat CAT JSD2 - - import
code.python.structure.import_alias_share ratio RATIO ABS - - import alias
code.python.structure.exception_construct cat CAT JSD2 - - exception construct
code.python.structure.comprehension_kind cat CAT JSD2 - - comprehension
code.python.structure.match_case_count hist HIST W1 11 - match statement
code.python.comments.comment_count int SUM NONE - - comment
code.python.comments.comment_line_share ratio RATIO ABS - - line
code.python.comments.comment_length hist HIST W1 121 - comment
code.python.comments.docstring_kind cat CAT JSD2 - - docstring
code.python.comments.docstring_length hist HIST W1 501 - docstring
code.toolchain.python_comment_marker cat CAT JSD2 - - marker event
code.parser.named_node_type cat CAT JSD2 - - named node
code.parser.named_parent_child cat CAT JSD2 - - named-node edge
code.parser.named_depth hist HIST W1 32 - named node
code.parser.identifier_length hist HIST W1 64 - identifier occurrence
code.parser.identifier_style cat CAT JSD2 - - identifier occurrence
code.parser.comment_kind cat CAT JSD2 - - comment
code.parser.comment_length hist HIST W1 256 - comment
text.linguistic.upos cat CAT JSD2 - - linguistic token
text.linguistic.dependency_relation cat CAT JSD2 - - linguistic token
text.linguistic.dependency_distance hist HIST W1 32 - non-root dependency arc
text.linguistic.morph_attribute cat CAT JSD2 - - morphology attribute event
text.linguistic.morph_coverage ratio RATIO ABS - - linguistic token
"""

SEMANTIC_VERSION = "1.0.0"


@dataclass(frozen=True)
class Feature:
    feature_id: str
    geometry: str
    reducer: str
    metric: str
    top_code: int | None
    runtime_sensitive: bool
    support_kind: str

    @property
    def family(self) -> str:
        return self.feature_id.rpartition(".")[0]

    @property
    def kind(self) -> str:
        return self.feature_id.partition(".")[0]


def _parsed() -> dict[str, Feature]:
    out = {}
    for line in _FEATURES.strip().splitlines():
        name, geometry, reducer, metric, top, rt, unit = line.split(" ", 6)
        out[name] = Feature(name, geometry, reducer, metric, None if top == "-" else int(top), rt == "y", unit)
    return out


FEATURES: dict[str, Feature] = _parsed()
SCHEMA = "feature_id string, family string, kind string, geometry string, reducer string, metric string, top_code int, runtime_sensitive boolean, support_kind string"


def registry(spark: SparkSession, prefix: str = "") -> DataFrame:
    """The registry as a table of at most 90 rows."""
    rows = [(f.feature_id, f.family, f.kind, f.geometry, f.reducer, f.metric, f.top_code, f.runtime_sensitive, f.support_kind) for f in FEATURES.values() if f.feature_id.startswith(prefix)]
    return spark.createDataFrame(rows, SCHEMA)
