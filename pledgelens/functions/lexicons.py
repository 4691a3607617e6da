"""Word lists and language packs.

A :class:`LanguagePack` holds everything about a language that the text
operators need: the token letters, the vowels, the lexicons, the gratitude
patterns, the currency words and the stop lists. ``RUSSIAN`` is the default;
``WESTERN`` serves mixed English, German, French and Spanish corpora.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Russian word lists, patterns and stop lists. Results depend on
# them literally, inflected forms and missing forms included.
# ---------------------------------------------------------------------------
SOCIAL_TERMS = (
    "мы нас нам нами наш наша наше наши "
    "вы вас вам вами ваш ваша ваше ваши "
    "команда сообщество группа коллектив союз объединение "
    "ассоциация организация клуб движение сеть круг "
    "друг друзья подруга товарищ коллега партнёр партнер "
    "единомышленник соратник сторонник участник волонтёр волонтер "
    "помощник поддержка спонсор меценат инвестор бэкер "
    "семья семейный родители дети родственники близкие "
    "люди человек общество народ гражданин население "
    "общественный социальный публичный совместный коллективный "
    "вместе совместно сообща совместить объединить объединиться "
    "присоединиться поддержать помочь помогать участвовать "
    "сотрудничать сотрудничество взаимодействие взаимопомощь "
    "краудфандинг сбор донор донация пожертвование "
    "взнос вклад финансирование содействие"
).split()

GRATITUDE_PATTERNS = [
    r"спасибо",
    r"благодар\w*",
    r"признателен",
    r"признательн\w*",
    r"признательность",
    r"от всего сердца",
    r"ценим вашу",
    r"слова благодарност\w*",
    r"низкий поклон",
    r"огромное спасибо",
    r"сердечно благодар\w*",
]

WE_FORMS = "мы нас нам нами наш наша наше наши нашего нашей нашему нашим нашими нашем".split()

I_FORMS = "я меня мне мной мною мой моя моё мои моего моей моему моим моими моём".split()

CERTAINTY_TERMS = (
    "точно конечно обязательно уверен уверена гарантированно "
    "безусловно несомненно определённо определенно достоверно "
    "бесспорно однозначно непременно непреложно факт "
    "гарантия гарантирован гарантирую убеждён убежден "
    "известно очевидно ясно неизбежно "
    "доказано проверено подтверждено реализуем выполним"
).split()

UNCERTAINTY_TERMS = (
    "может возможно наверное наверно вероятно "
    "пожалуй если предположительно "
    "кажется думаем думаю надеемся надеюсь планируем "
    "планируется стараемся постараемся попробуем "
    "хотим хотелось рассчитываем ожидаем предполагаем "
    "вероятность шанс риск неопределённость неопределенность"
).split()

CURRENCY_PATTERNS = [r"руб", r"рублей", r"р\.", r"₽", r"тыс", r"тысяч", r"млн", r"миллион", r"копейк"]

TOPIC_STOP_WORDS = (
    "и в на не что с по а как это у за "
    "но из от к о же то для бы так вот "
    "был быть есть или еще уже мы вы он она "
    "они я ты наш ваш свой этот тот весь все"
).split()

TFIDF_EXTRA_STOP_WORDS = (
    "при до со об без через над под между после "
    "также который которая которые которого"
).split()

RUSSIAN_VOWELS = "аеёиоуыэюя"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class LanguagePack:
    """Language parameters of the text operators.

    ``letters`` and ``tfidf_letters`` are the insides of a regex character
    class; ``vowels`` lists lower-case vowels (both cases are counted).
    """

    name: str
    letters: str
    tfidf_letters: str
    vowels: str
    social: list[str]
    certainty: list[str]
    uncertainty: list[str]
    we_forms: list[str]
    i_forms: list[str]
    gratitude: list[str]
    currency: list[str]
    topic_stop: list[str]
    tfidf_stop: list[str]
    extra: dict = field(default_factory=dict)

    @property
    def token_pattern(self) -> str:
        return f"[{self.letters}]+"

    @property
    def tfidf_pattern(self) -> str:
        return f"[{self.tfidf_letters}]+"

    @property
    def both_case_vowels(self) -> str:
        return self.vowels + self.vowels.upper()

    def lexicons(self) -> dict[str, list[str]]:
        """Category name to terms, for inventories and joins."""
        return {
            "social": self.social,
            "gratitude": self.gratitude,
            "we": self.we_forms,
            "i": self.i_forms,
            "certainty": self.certainty,
            "uncertainty": self.uncertainty,
        }


RUSSIAN = LanguagePack(
    name="ru",
    letters="а-яёА-ЯЁa-zA-Z",
    tfidf_letters="а-яёА-ЯЁ",
    vowels=RUSSIAN_VOWELS,
    social=SOCIAL_TERMS,
    certainty=CERTAINTY_TERMS,
    uncertainty=UNCERTAINTY_TERMS,
    we_forms=WE_FORMS,
    i_forms=I_FORMS,
    gratitude=GRATITUDE_PATTERNS,
    currency=CURRENCY_PATTERNS,
    topic_stop=TOPIC_STOP_WORDS,
    tfidf_stop=TOPIC_STOP_WORDS + TFIDF_EXTRA_STOP_WORDS,
)

#: Function-word stand-ins for corpora in four Western European languages.
WESTERN = LanguagePack(
    name="western",
    letters=r"\p{L}",
    tfidf_letters=r"\p{L}",
    vowels="aeiouyäöüáéíóúàèìòùâêîôûëï",
    social="and und et y with mit avec con they them their sie ihr ils elles ellos".split(),
    certainty="is ist est es are sind sont was that das".split(),
    uncertainty="by als par por or oder ou if wenn si sur".split(),
    we_forms="we us our wir uns nous nos notre nosotros it sich se".split(),
    i_forms="i me my ich mich mein je moi mon yo mi".split(),
    gratitude=[r"thank\w*", r"danke", r"merci", r"gracias", r"for th\w*", r"for", r"pour", r"para"],
    currency=[r"\$", r"€", r"£", r"usd", r"eur"],
    topic_stop=(
        "the of and to a in is that it for was on with be by as this are at from "
        "der die und den von zu das mit sich auf des für ist nicht dem im ein "
        "de la le et les en un du une que pour est qui par dans sur au pas "
        "el y los se del las por no con su una es para al"
    ).split(),
    tfidf_stop=(
        "the of and to a in is that it for was on with be by as this are at from "
        "der die und den von zu das mit sich auf des für ist nicht dem im ein als eine "
        "de la le et les en un du une que pour est qui par dans sur au pas avec "
        "el y los se del las por no con su una es para al lo"
    ).split(),
)


def lexicon_table(spark: SparkSession, pack: LanguagePack = RUSSIAN) -> DataFrame:
    """The pack's lexicons as a ``(category, kind, term)`` table."""
    rows = [
        (category, "pattern" if category == "gratitude" else "term", term)
        for category, terms in pack.lexicons().items()
        for term in terms
    ]
    return spark.createDataFrame(rows, "category string, kind string, term string")
