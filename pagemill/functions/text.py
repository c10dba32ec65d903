"""Column functions on texts: comparing, masking, keywords, fitness of evidence, grading. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, endings and patterns of the Korean material that decide results.
QUESTION_WORDS = ["어떻게", "무엇", "무엇인가", "무엇인지", "무엇일까", "뭐", "뭐야", "뭐가", "뭘", "왜", "언제", "어디", "어떤", "무슨", "어느", "얼마나", "어때"]
VERB_ENDING = "^[가-힣]$|[가-힣](어|아|요|까|니|나|해|돼|라|야|려면|으면|하면)$"
PARTICLE = "(이란|에서|으로|란|로|은|는|이|가|을|를|의|와|과|에|도|만)$"
# The same within a text, where a word ends before white space. A particle stays on a word that would keep one character;
# then no part of it goes either. Java looks behind by UTF-16 units, of which two characters have up to four.
_DROPPED = f"(?U)(?<!\\S)(?:{'|'.join(QUESTION_WORDS)}|[가-힣]|\\S*{VERB_ENDING.split('|', 1)[1].removesuffix('$')})(?!\\S)"
_PARTICLE = f"(?U)(?<=\\S{{2,4}})(?:{PARTICLE.removesuffix('$').replace('|란', '|(?<!이)란').replace('|로', '|(?<!으)로')})(?!\\S)"
GATE_STOPWORDS = ["자료형", "파이썬", "파이썬의", "값을", "저장하는", "공간", "기본"]
GATE_ALIASES = {"불리언": ["boolean", "bool"], "불": ["bool", "불 자료형"], "숫자형": ["숫자"]}
DEFINITION = "(?:은|는|이란|란)\\s.{4,}?(?:의미한다|의미합니다|말한다|말합니다|뜻한다|뜻합니다|가리킨다|가리킵니다|부른다|부릅니다|라고 한다|라고 합니다|이라고 한다|이라고 합니다)[.!]?$"
UNFIT_PATTERNS = {
    "도입·예고": "알아보(자|겠|도록)|살펴보(자|겠|도록)|배워 ?보(자|겠)|해 ?보(자|겠)|다음 (장|절|절에서)|마무리|소개한다|시작해 ?보",
    "회고": "(배웠|살펴봤|알아봤|보았|봤)(습니다|다)|앞(에서|서)\\s*(\\S+\\s*){0,3}(배웠|다뤘|설명)",
    "비유": "비유|빗대|마치 |(인간|사람|현실|실생활|일상)(으로|에서|세계)\\s*(치면|비유|는|에서는)|드라마|유전형질|재산",
    "평가·감상": "매력|재미있|흥미|장벽|중요(하다|합니다)|어렵(게|다고) 느|걱정|두려",
}
OX_TRUE = ["o", "ㅇ", "t", "true", "참", "맞음", "맞다"]
OX_FALSE = ["x", "f", "false", "거짓", "틀림", "틀리다"]
CHOICE_PREFIX = "^\\s*(?:[A-Da-d1-4]\\)|[A-Da-d1-4]\\.\\s|[①②③④])\\s*"
LLM_BLANK = "(?<![A-Za-z0-9])_{3,}(?![A-Za-z0-9])"
BLANK = "____"
MAX_ANSWER_CHARS, MIN_EVIDENCE_CHARS = 30, 8
SHORT_UNIT_CHARS, SHORT_PENALTY, MIN_FACT_CHARS = 80, 0.1, 40
#: White space in the Unicode sense, as (?U)\\s has it.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SENTENCE_SPLIT = "(?U)(?<=[.!?])\\s+|\\n+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.btrim(c, F.lit(WHITE))


def squash(c: Column) -> Column:
    """For comparing: straight quotes, no white space, no end marks."""
    return F.rtrim(F.translate(c, "‘’“”" + WHITE, "''\"\""), F.lit(".!?"))


def contains(text: Column, part: Column) -> Column:
    return F.contains(squash(text), squash(part))


def quoted(c: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def answer_pattern(answer: Column) -> Column:
    """Finds an answer as a word: a side that is a letter, digit or underscore must not have another one beside it."""
    word = "^[A-Za-z0-9_]"
    left = F.when(answer.rlike(word), F.lit("(?<![A-Za-z0-9_])")).otherwise(F.lit(""))
    right = F.when(answer.rlike("[A-Za-z0-9_]$"), F.lit("(?![A-Za-z0-9_])")).otherwise(F.lit(""))
    return F.concat(left, quoted(answer), right)


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def make_question(text: Column, answer: Column) -> Column:
    """struct(question, blanks, error): the text with the answer masked.

    A run of three underscores or more that touches no letter or digit is a blank. With one blank written, further
    occurrences of the answer are masked too; with none, all are masked as words, or else the first as it stands.
    """
    return let(strip(answer), lambda a: let(F.regexp_replace(text, LLM_BLANK, BLANK), lambda t: _masked(t, a)))


def _masked(text: Column, answer: Column) -> Column:
    def asked(masked: Column) -> Column:
        at = F.instr(text, answer)
        first_only = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(BLANK), F.substring(text, at + F.length(answer), F.length(text)))
        return F.when(F.contains(text, F.lit(BLANK)) | F.contains(masked, F.lit(BLANK)), masked).otherwise(first_only)

    def result(asked: Column) -> Column:
        return let(_mask_error(text, answer, asked), lambda error: F.struct(F.when(error.isNull(), asked).alias("question"), F.when(error.isNull(), occurrences(asked, BLANK)).alias("blanks"), error.alias("error")))

    # masked, asked and error are each used several times
    return let(let(F.regexp_replace(text, answer_pattern(answer), BLANK), asked), result)


def _mask_error(text: Column, answer: Column, asked: Column) -> Column:
    has_blank = F.contains(text, F.lit(BLANK))
    written = occurrences(text, BLANK)
    refilled = filled(asked, answer)
    return (
        F.when(F.length(answer) == 0, F.lit("정답이 비어 있음"))
        .when(F.length(answer) > MAX_ANSWER_CHARS, F.concat(F.lit("정답이 너무 김("), F.length(answer), F.lit("자)")))
        .when(has_blank & (written > 1), F.concat(F.lit("LLM이 쓴 빈칸이 "), written, F.lit("개, 빈칸은 하나만 쓸 것")))
        .when(has_blank & (F.length(strip(F.replace(asked, F.lit(BLANK), F.lit("")))) == 0), F.lit("문제에 빈칸 말고 내용이 없음"))
        .when(~has_blank & ~F.contains(text, answer), F.concat(F.lit("정답이 문장에 없음: "), answer))
        .when(~has_blank & (squash(answer) == squash(text)), F.lit("정답이 문장 전체"))
        .when(~has_blank & (refilled != text) & (squash(refilled) != squash(text)), F.lit("채운 문장이 원문과 다름"))
    )


def filled(question: Column, answer: Column) -> Column:
    return F.replace(question, F.lit(BLANK), answer)


def question_keywords(question: Column) -> Column:
    """A question without interrogatives, verbs and particles; the question itself if nothing is left."""
    # over the whole text at once: an array of its words would cost an object and several patterns a word
    bare = F.regexp_replace(question, "(?U)(?<!\\S)[?!.,~]++|(?<![?!.,~])[?!.,~]++(?!\\S)", "")
    korean = F.regexp_replace(F.regexp_replace(bare, _DROPPED, ""), _PARTICLE, "")
    some = F.when(question.rlike("[가-힣]"), korean).otherwise(bare)
    return let(strip(F.regexp_replace(some, "(?U)\\s+", " ")), lambda joined: F.when(F.length(joined) > 0, joined).otherwise(question))


def _aliases(words: Column) -> Column:
    table = F.create_map(*[x for k, v in GATE_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))


def concept_tokens(concept: Column) -> Column:
    """Words of a concept that a page's path may show: in lower case, without stop words, with their aliases."""
    words = F.filter(F.split(concept, "(?U)[\\s,]+"), lambda w: F.length(w) > 0)
    cut = F.transform(words, lambda w: F.when(w.rlike("^[A-Za-z]+문$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    own = F.transform(F.filter(cut, lambda w: (F.length(w) >= 2) & ~w.isin(GATE_STOPWORDS)), F.lower)
    tokens = F.concat(own, _aliases(words))
    return F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lower(concept)))


def search_query(concept: Column) -> Column:
    found = _aliases(F.split(concept, "(?U)[\\s,]+"))
    return F.when(F.size(found) > 0, F.concat(concept, F.lit(" ("), F.array_join(found, ", "), F.lit(")"))).otherwise(concept)


def short_penalty(text: Column) -> Column:
    return SHORT_PENALTY * F.greatest(F.lit(0.0), 1 - F.length(strip(text)) / SHORT_UNIT_CHARS)


def sentence_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_SPLIT), strip), lambda s: F.length(s) > 0)


def unfit_reason(text: Column, has_code: Column, patterns: dict[str, str] | None = None, definition: str = DEFINITION, exclude_code: bool = True, min_facts: int = MIN_FACT_CHARS) -> Column:
    """Why a paragraph cannot be evidence; null if it can.

    patterns: reason -> pattern, in order; the first two reasons condemn a paragraph by its first sentence, unless a later
    sentence is a clean definition. Otherwise sentences that match nothing are facts, and too few of them give the
    commonest reason (the earliest in the text among equals).
    """
    patterns = patterns or UNFIT_PATTERNS
    names = list(patterns)
    sentences = sentence_list(text)
    kind = lambda s: F.coalesce(*[F.when(s.rlike(f"(?U){p}"), F.lit(k)) for k, p in enumerate(patterns.values())], F.lit(-1))
    kinds = F.transform(sentences, kind)
    clean_definition = F.exists(F.slice(sentences, F.lit(2), F.greatest(F.size(sentences), F.lit(1))), lambda s: s.rlike(f"(?U){definition}") & (kind(s) < 0))
    first = F.get(sentences, F.lit(0))
    opening = F.coalesce(*[F.when(first.rlike(f"(?U){patterns[n]}"), F.lit(f"{n}(첫 문장)")) for n in names[:2]])
    facts = F.aggregate(F.filter(sentences, lambda s: kind(s) < 0), F.lit(0), lambda a, s: a + F.length(s))

    def vote(k: int, name: str) -> Column:
        return F.struct(F.size(F.filter(kinds, lambda x: x == k)).alias("n"), (-F.array_position(kinds, k)).alias("early"), F.lit(name).alias("name"))

    votes = F.array(*[vote(k, n) for k, n in enumerate(names)])
    best = F.array_max(F.filter(votes, lambda v: v["n"] > 0))
    code = F.when(has_code & F.lit(exclude_code), F.lit("코드 포함"))
    return F.coalesce(F.when(opening.isNotNull() & ~clean_definition, opening), code, F.when(facts < min_facts, F.coalesce(best["name"], F.lit("내용 부족"))))


def norm_reply(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(strip(c), "^['\"` ]+|['\"` ]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "(?U)\\s+", ""), "^\\.", ""), "\\(\\)$", "")


def grade(fmt: Column, ox_answer: Column, answer_index: Column, accepted: Column, reply: Column) -> Column:
    """true, false, or null where only the learner can tell."""
    reply = strip(reply)
    key = F.lower(reply)
    ox = F.when(key.isin(OX_TRUE), ox_answer).when(key.isin(OX_FALSE), ~ox_answer)
    free = F.when(F.exists(accepted, lambda a: norm_reply(a) == norm_reply(reply)), F.lit(True)).when(F.length(reply) == 0, F.lit(False))
    return F.when(fmt == "ox", ox).when(fmt == "mcq", reply == (answer_index + 1).cast("string")).otherwise(free)


def strip_choice_prefixes(choices: Column) -> Column:
    return F.when(F.forall(choices, lambda c: c.rlike(CHOICE_PREFIX)), F.transform(choices, lambda c: F.regexp_replace(c, CHOICE_PREFIX, ""))).otherwise(choices)


def exposed(answer: Column, text: Column) -> Column:
    """Whether an identifier's last name stands in the text; other answers may."""
    core = F.regexp_replace(F.regexp_replace(answer, "\\(\\)$", ""), "^.*\\.", "")
    return answer.rlike("^[A-Za-z_][\\w.]*(\\(\\))?$") & F.coalesce(F.regexp_like(text, F.concat(F.lit("(?<!\\w)"), quoted(core), F.lit("(?!\\w)"))), F.lit(False))


def cited_numbers(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("\\[(\\d+)\\]"), F.lit(1)), lambda n: n.cast("int"))))


def markdown_escaped(c: Column) -> Column:
    return F.regexp_replace(c, "([\\\\`*_{}\\[\\]<>()#+\\-.!|~$])", "\\\\$1")


def highlighted(text: Column, part: Column) -> Column:
    """The first occurrence of a part in bold."""
    at = F.instr(text, part)
    return F.when((at > 0) & (F.length(part) > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit("**"), part, F.lit("**"), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)
