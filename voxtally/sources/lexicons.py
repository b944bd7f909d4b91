"""Word lists that steer tokenizing and topic naming.

The domain dictionary is a parameter: read it with :func:`read_long_words` from a file with one word per
line. The shorter Korean lists of the review domain are fixed values and stand below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

# Word lists up to this long are inlined as literals; longer ones become files (operators/word_scan.py).
INLINE_WORDS = 2_000

# --- fixed values: part-of-speech tags that may become keywords ---------------------------------
TARGET_TAGS = ("NNG", "NNP", "VA", "XR")

# --- fixed values: boilerplate that review sites append to the text -----------------------------
BOILERPLATE = (
    r"\d{4}\s\d{2}\s\d{2}\s\d{2}\s\d{2}\s\d{2}\s에\s등록된\s네이버\s페이\s구매평",
    r"네이버페이에서\s작성된\s후기입니다",
)

# --- fixed values: labels -----------------------------------------------------------------------
NOISE_LABEL = "노이즈"
TOPIC_PREFIX = "토픽_"


def _words(text: str) -> tuple[str, ...]:
    """Comma-separated words, first occurrence only."""
    return tuple(dict.fromkeys(w.strip() for w in text.split(",") if w.strip()))


def _groups(text: str) -> tuple[tuple[str, ...], ...]:
    """One word list per line."""
    return tuple(_words(line) for line in text.strip().splitlines())


# --- fixed values: stop words of the keyword step -----------------------------------------------
KOREAN_STOP_WORDS = _words("""
네이버, 페이, 후기, 작성, 등록, 포인트, 아울렛, 구매, 상품, 주문, 배송, 생각, 그냥, 진짜, 정도, 많이, 조금,
느낌, 착용, 구입, 종류, 보다, 있다, 없다, 같다, 되다, 하다, 이다, 받다, 사다, 입다, 좋다, 예쁘다, 편하다,
만족, 잘맞다, 괜찮다, 남편, 신랑, 아내, 아들, 딸, 아이, 엄마, 선물, 남자친구, 여자친구, 합리적, 감수, 희망,
지대, 직장, 화요일, 휴일, 각질, 소장, 타월, 아파트, 공원, 습관, 카톡, 커플, 대비, 가격, 특가, 할인, 세일,
행사, 쿠폰, 보통, 평범, 무난, 약간, 빠르다, 빠르, 포장, 도착, 조아요, 조아, 이뻐요, 넘, 넘나, 각오, 민망하다,
피해자, 흔하다, 역대, 가관, 계산, 한마디, 항의, 폭발, 통보, 계기, 캡쳐, 연말, 피치라이닝, 윈드자켓, 골프 마스크,
후디, 프리런, 짐볼, 차단, 냉감, 안다르, 젝시믹스, 젝스믹스, 젝시미스, 젝스미스, 룰루레몬, 휠라, 젝시, 젝믹, 룰루,
블랙, 화이트, 검정, 흰색, 아이보리, 베이지, 그레이, 네이비, 핑크, 카키, 브라운, 민트, 블루, 레드, 옐로우, 그린,
퍼플, 차콜, 색상, 컬러, 색깔, 색, 페이스슬림, 라이트더블
""")

# --- fixed values: further stop words of the low-rating scope -----------------------------------
KOREAN_NEG_STOPWORDS = _words("""
좋다, 편하다, 만족, 추천, 강추, 감사, 최고, 굿, 짱, 잘맞다, 딱맞다, 맞다, 부드럽다, 따뜻하다, 시원하다,
재구매, 또살다, 합리적, 인지도, 단정, 향수
""")

# --- fixed values: analyser form -> normal form -------------------------------------------------
KOREAN_SYNONYMS = {
    "편하": "편하다",
    "이쁘": "예쁘다",
    "귀여": "귀엽다",
    "신축": "신축성",
    "데님": "청바지",
    "진": "청바지",
    "조거": "조거팬츠",
    "레깅": "레깅스",
    "스판": "신축성",
    "스팬": "신축성",
    "탄성": "신축성",
    "향": "냄새",
}

# --- fixed values: seed topics of the all-reviews scope, one line per seed ----------------------
KOREAN_SEEDS = _groups("""
하비, 골반, Y존, 오버핏, 기장, 사이즈업, 한사이즈업, 밑위, 기장감, 사이즈, 크다, 작다, 짧다, 길다, 타이트, 허리, 반업, 정사이즈, 한사이즈, 적다
기모, 메쉬, 보풀, 이염, 변형, 탄탄, 물빠짐, 세탁망, 건조기, 탈색, 내구성, 세탁, 세탁기, 얇다, 늘어나다, 헤지다, 빠짐, 심하다
신축성, 땀흡수, 통기성, 흡습속건, 복원력, 미끄럼방지, 활동성, 비침, 땀자국, 움직임
착용감, 불편, 압박감, 조이다, 끼다, 허리말림, 배말림, 말리다, 올라가다, 흘러내리다, 텐션감, 밀착, 딱딱하다, 뻣뻣하다, 무겁다
아프다, 발가락, 발볼, 발등, 발바닥, 꽉끼다, 좁다, 물집, 벗겨지다, 미끄럽다, 쿠션, 아치, 깔창, 착화감
자국, 땀자국, 브라, 팬티, 심리스, 일체, 후크, 끊어지다, 찢어지다, 올데이핏, 레깅스팬티, 브라탑
반품, 교환, 환불, 불량, 보풀, 불편, 실망, 검수, 고객, 전화, 연락, 센터, 처리, 포장, 비닐, 재판매
색상, 화면, 실물, 다르다, 차이, 실망, 사진, 밝다, 어둡다, 톤, 컬러
올드머니룩, 고프코어, 꾸안꾸, 웜톤, 발레코어, Y2K, 셋업
재구매, 인생바지, 강추, 교복템, 후회없다, 실패없다, 최애템
가성비, 가심비, 갓성비, 가격대비, 할인, 특가, 비싸다, 아깝다
""")

# --- fixed values: seed topics of the low-rating scope, one line per seed -----------------------
KOREAN_LOW_SEEDS = _groups("""
사이즈, 크다, 작다, 기장, 짧다, 길다, 길이, 한사이즈업, 타이트, 허리, 골반, 밑위, 반업, 정사이즈, 스몰, 소매, 한사이즈, 봉제선, 박음질, 삐뚤다, 비대칭
보풀, 이염, 물빠짐, 변형, 내구성, 탈색, 세탁, 건조, 얇다, 늘어나다, 먼지, 냄새, 식초, 올트임, 구멍, 뜯어지다, 해지다
불편, 압박감, 조이다, 끼다, 허리말림, 배말림, 말리다, 올라가다, 흘러내리다, 내려가다, 밀착, 딱딱하다, 무겁다, 뻣뻣하다, 답답하다, 눌리다, 걸리적, 쓸리다, 당기다
아프다, 발가락, 발볼, 발등, 발바닥, 꽉끼다, 좁다, 물집, 벗겨지다, 쿠션, 아치, 깔창, 착화감, 미끄럽다, 미끄러지다, 발목
반품, 교환, 환불, 불가, 불량, 검수, 불만, 불쾌감, 고객, 전화, 연락, 센터, 처리, 포장, 비닐, 재판매, 누락, 오배송, 지연, 묵묵부답, 소비자기만
화면, 실물, 다르다, 차이, 사진, 밝다, 어둡다
비싸다, 아깝다, 돈아깝다, 가격
""")


@dataclass(frozen=True)
class Lexicon:
    """The word lists of one scope. Repeats are dropped, order is kept."""

    user_dict: Sequence[str] = ()
    stop_words: Sequence[str] = ()
    neg_stopwords: Sequence[str] = ()
    synonyms: Mapping[str, str] = field(default_factory=dict)
    seeds: Sequence[Sequence[str]] = ()
    clean_patterns: Sequence[str] = ()

    def __post_init__(self):
        for name in ("user_dict", "stop_words", "neg_stopwords"):
            object.__setattr__(self, name, tuple(dict.fromkeys(getattr(self, name))))

    def longest(self) -> int:
        """The length of the longest word list."""
        return max(len(self.user_dict), len(self.stop_words), len(self.neg_stopwords), len(self.synonyms))

    def fits_inline(self) -> bool:
        """Whether all lists are short enough for literals in an expression."""
        return self.longest() <= INLINE_WORDS

    def seed_words(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w for group in self.seeds for w in group))


def korean_lexicon(user_dict: Sequence[str], low: bool = False) -> Lexicon:
    """The Korean lists with the caller's domain dictionary, for one of the two scopes.

    The dictionary has no default: without it nothing is matched and coverage is zero.
    """
    base = Lexicon(
        user_dict=user_dict,
        stop_words=KOREAN_STOP_WORDS,
        neg_stopwords=KOREAN_NEG_STOPWORDS,
        synonyms=KOREAN_SYNONYMS,
        seeds=KOREAN_SEEDS,
        clean_patterns=BOILERPLATE,
    )
    return replace(base, seeds=KOREAN_LOW_SEEDS) if low else base


def read_long_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A word list of any length from a text file, one word per line, for a :class:`Lexicon`.

    The driver holds the list. Past the inline bound the operators scan for it.
    """
    rows = spark.read.text(path).toLocalIterator()
    return tuple(dict.fromkeys(word for r in rows if (word := r.value.strip())))


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """A word list of any length as a table with the column ``word``."""
    return (
        spark.read.text(path).selectExpr("trim(value) AS word").where("word <> ''").dropDuplicates()
    )


def seed_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """``(seed_id, pos, word)``: the seed topics, ids by position."""
    rows = [
        (seed_id, pos, word)
        for seed_id, group in enumerate(lexicon.seeds)
        for pos, word in enumerate(group)
    ]
    return spark.createDataFrame(rows, "seed_id int, pos int, word string")
