"""Rules as data. The Russian lexicon; a caller may bring rules for another language."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -------------------------------------------------------------------------
SWEETNESS = [
    (r"brut[\s-]*nature|брют[\s-]*натур|экстра[\s-]*брют|extra[\s-]*brut|zero", 0),
    (r"экстра[\s-]*драй|extra[\s-]*dry|extra[\s-]*sec", 1),
    (r"полусух|semi[\s-]*dry|demi[\s-]*dry|off[\s-]*dry", 1),
    (r"полусладк|semi[\s-]*sweet|demi[\s-]*sec|демисек", 2),
    (r"(?<!полу)(?<!не )сладк(ое|ий|ая)\b(?!\s*(послевкус|нот|тон|аромат|ягод|фрукт))|\bsweet\b|десертн|ликерн", 3),
    (r"брют|brut|\bсухое\b|\bсухой\b|\bdry\b|\bsec\b", 0),
]
SWEETNESS_SLUG = [("polusuhoe", 1), ("polusladkoe", 2), ("sladkoe", 3), ("suhoe", 0), ("brut", 0), ("dry", 0), ("sweet", 3), ("semi", 2)]
SWEETNESS_PHRASES = [
    r"(полусухое|полусладкое|сухое|сладкое|брют\w*)\s*(белое|красное|розовое|оранжевое|игристое)?\s*(вино|игристое)",
    r"(вино|игристое)\s*[-–,]?\s*(полусухое|полусладкое|сухое|сладкое)",
]
SPARKLING = r"игрист|брют|\bbrut\b|шампанск|просекко|креман|cremant|пет[\s-]?нат|pet[\s-]?nat|жемчуж|пузырьк|перляж|перлаж"
TANNIN = ("танин", r"мягк|нежн|шелков|бархат|тонк|округл|легк|деликат|незаметн|слаб|шлифован", r"умерен|средн|сбалансир|гармонич|аккуратн", r"выражен|плотн|мощн|структур|терпк|крепк|сильн|высок|насыщ|ощутим|заметн|грубоват|вяжущ")
ACIDITY = ("кислотн", r"мягк|нежн|низк|неярк|приглушен|округл|деликат", r"умерен|средн|сбалансир|гармонич|достаточн|приятн", r"высок|ярк|выражен|свеж|живая|живой|острая|острый|хруст|сочн|освежающ|пронзительн|энергичн")
ACIDITY_DIMINUTIVE = "кислинк"
BODY = [
    (r"легк\w*|питк\w*|невесом\w*|воздушн\w*", -0.8, 1.6),
    (r"изящн\w*|деликатн\w*|освежающ\w*|нежн\w*", -0.3, 0.6),
    (r"плотн\w*|мощн\w*|густ\w*|массивн\w*|концентрирован\w*|полнотел\w*|экстрактивн\w*|полн(?:ый|ое|ым|ая)\s+(?:вкус|тел)\w*", 1.0, 1.6),
    (r"насыщенн\w*|объемн\w*|богат\w*|структурн\w*|интенсивн\w*|терпк\w*|глубок\w*", 0.4, 0.8),
]
BODY_MIDDLE = r"средн\w*\s*(?:тел|плотн|насыщ|структур)\w*|умеренн\w*\s*(?:тел|плотн|насыщ)\w*|среднетел\w*"
OAK = r"дуб|бочк|баррик|ванил|тост|кокос|обжиг|кедр"
MONTHS, YEARS, AGEING = r"(\d{1,2})\s*(?:[-–]\s*\d{1,2}\s*)?(месяц|мес\b)", r"(\d{1,2})\s*(лет|года|год)\b", "выдерж"
AROMA = {
    "красные ягоды": r"вишн|малин|клубник|земляник|красн\w+ ягод|черешн|брусник|клюкв|красн\w+ смородин|гранат",
    "тёмные ягоды": r"черн\w+ смородин|ежевик|черник|слив[аыуо]|сливов|чернослив|тут\b|темн\w+ ягод|терн\b|боярышник",
    "цитрус": r"цитрус|лимон|лайм|грейпфрут|мандарин|апельсин|цедр|бергамот",
    "косточковые": r"персик|абрикос|нектарин|желтая слив|алыч",
    "тропические": r"тропич|ананас|манго|маракуй|банан|папай|личи|экзотич",
    "яблоко/груша": r"яблок|груш|айв|дюшес",
    "цветы": r"цвет(ы|ов|очн|ущ)|акаци|роз[аыуе]\b|фиалк|жасмин|липа|липов|ромашк|бузин|герань",
    "травы/зелень": r"трав|зелен|скошенн|мят|базилик|тимьян|розмарин|крапив|чабрец|полын|шалфей|фенхель|спарж",
    "пряности/перец": r"пряност|пряный|пряные|пряным|специ|перц|перец|гвоздик|корица|корицей|мускатн\w+ орех|анис|лакрич|можжевел",
    "дуб/ваниль": r"дуб|ванил|тост|кокос|кедр|бочк|карамел",
    "шоколад/кофе": r"шоколад|кофе|какао|мокко",
    "мёд": r"\bмед[а-я]*\b|медов|воск|нектар",
    "минеральность": r"минерал|кремень|кремн|камен|соленост|солоноват|морск|йод",
    "землистое/грибное": r"земл|гриб|трюфел|лесн\w+ подстил|подлесок|прель|мох\b|табак|кожа|кожан",
    "орехи": r"орех|миндал|фундук|грецк|арахис",
    "сухофрукты": r"сухофрукт|изюм|курага|инжир|финик|чернослив|джем|варень|конфитюр|цукат",
    "выпечка/дрожжи": r"бриош|дрожж|хлеб|выпечк|сливочн|печень|булочк|автолиз",
    "мускат": r"мускат",
    "дым/смола": r"дым|копчен|смол|гарь|деготь|жженый|горелый|графит",
}
FOOD = {
    "сыр": r"сыр",
    "красное мясо": r"говядин|стейк|баранин|ягнен|дичь|шашлык|мясо|мясн|колбас",
    "птица": r"птиц|курин|индейк|утк|курица",
    "свинина": r"свинин|ветчин|бекон",
    "рыба": r"рыб|лосос|форел|семг|тунец|осетр|судак|треск|дорад",
    "морепродукты": r"морепродукт|устриц|креветк|мидии|краб|кальмар|гребешк|лобстер",
    "десерт": r"десерт|торт|пирожн|шоколад|мороженое|фрукт",
    "закуски": r"закуск|канапе|тапас|орешк|оливк",
    "паста/пицца": r"паст[аыу]|макарон|пицц|ризотто|лазань",
    "овощи/салат": r"овощ|салат|гриб",
    "острое/азиатская": r"остр|азиатск|карри|тайск|суши|роллы|японск|восточн",
    "аперитив": r"аперитив",
}
PAIRING = r"подав|сочета|гастроном|подойд|подходит|идеал|хорош\w* к|составит|компани|\bк (мяс|рыб|сыр|птиц|десерт|закуск|блюд)|блюдам|сырам|мясу|рыбе"
SERVE = r"(\d{1,2})\s*[-–—]\s*(\d{1,2})\s*°"
ALCOHOL = [r"(?:алкогол\w*|крепост\w*)\W{0,12}(\d{1,2}(?:[.,]\d)?)\s*%", r"(\d{1,2}(?:[.,]\d)?)\s*%\s*(?:об|vol|алк)"]
NOT_GRAPES = ["молдова", "белые сорта винограда", "красные сорта винограда"]
GRAPES = {
    "пино черный": "Пино Нуар",
    "пино чёрный": "Пино Нуар",
    "пино чёрный (пино нуар)": "Пино Нуар",
    "пино нуар": "Пино Нуар",
    "сира (шираз)": "Сира",
    "шираз": "Сира",
    "мюллер тургау": "Мюллер-Тургау",
    "мюллер-тургау": "Мюллер-Тургау",
    "совиньон": "Совиньон Блан",
}
GUARDRAILS = {
    "minor": r"мне (1[0-7]|[5-9])\s*(лет|год)|мне нет 18|несовершеннолет|школьни|(для|ребенк\w*|подростк\w*).{0,15}(вино|выпить|алкогол)|ребенку|подростку",
    "pregnant": r"беременн|кормлю грудью|грудное вскармлив|жду ребенка",
    "driving": r"за рулем|поеду за руль|сам за рулем|после этого еду|поведу машину|поведу авто",
    "intoxicate": r"напиться|напоить|споить|опьянеть|захмелеть|чтобы забыться|залить гореств|надраться|нажраться|быстрее опьян|чтобы (быстрее )?опьян",
    "quantity": r"сколько (надо|нужно|можно) выпить|сколько выпить|сколько бутылок|норма алкогол|литр",
    "health": r"антибиотик|лекарств|таблетк\w*.{0,20}(вино|алкогол)|печен\w+ болит|панкреатит|алкоголиз|зависим|кодировк|завязал|завязать|в завязке|трезв\w+ образ|не пью",
    "decline": r"не хочу (вино|алкогол|пить)|не буду (пить|вино)|не пью|без алкогол|безалкогол|откажусь|не предлагай вино|не надо вино",
}
BANNED_TONE = [
    r"обязательно (попробуйте|выпейте|возьмите|закажите)",
    "не пожалеете",
    "порадуйте себя",
    r"пора (открыть|выпить)",
    "как насчет бокал",
    "расслабьтесь с",
    "вы заслуживаете",
    r"невероятн\w+ вино",
    r"лучше всего (выпить|пить)",
    "нужно выпить",
    r"стоит (выпить|попробовать)",
    "настоятельно",
    "наливайте",
    "еще один бокал",
    "еще по бокал",
    "за компанию выпейте",
    r"без вина (не )?обойтись",
]
#: Sections of a description: their words, headings (whether these go), and labels that go.
SECTIONS = [
    ("color", r"\bцвет\w*|\bокрас\w*"),
    ("aroma", r"аромат\w*|\bбукет\w*|\bв носу\b"),
    ("taste", r"вкус\w*|послевкус\w*|танин\w*|текстур\w*|\bфиниш\w*|\bфинал\w*|\bво рту\b"),
    ("food", r"гастроном\w*|сочета\w*|аперитив\w*|подава\w*|\bподойд\w*|\bподходит к\b|\bк (?:мяс|рыб|сыр|птиц|блюд|дич|морепр|десерт|паст|закуск|салат|фрукт|шашлык|стейк)\w*"),
    ("tech", r"винификац\w*|фермент\w*|мацерац\w*|\bвыдерж\w*|\bбочк\w*|купаж\w*|\bурожа\w*|\bсбор\w*|брожен\w*|\bсусл\w*|\bлоз\w*|виноградник\w*|\bразлит\w*"),
]
SECTION_HEADINGS = [
    ("tech", r"\s*(технолог\w*|техника винификации|особенности технологии|технологические операции|технология производства)\s*:", True),
    ("other", r"\s*(награды|сортовой состав|сорта винограда|тираж|декантац\w*)\s*:", False),
]
SECTION_LABEL = r"\s*(вкус и аромат|вкус|аромат|цвет|сочетания|гастрономия|финиш|послевкусие)\s*:\s*"
# ---- end of fixed values ------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """The rules of one language; patterns are Java's, with Unicode classes switched on."""

    sweetness: list = field(default_factory=lambda: SWEETNESS)
    sweetness_slug: list = field(default_factory=lambda: SWEETNESS_SLUG)
    sweetness_phrases: list = field(default_factory=lambda: SWEETNESS_PHRASES)
    sparkling: str = SPARKLING
    tannin: tuple = TANNIN
    acidity: tuple = ACIDITY
    acidity_diminutive: str = ACIDITY_DIMINUTIVE
    body: list = field(default_factory=lambda: BODY)
    body_middle: str = BODY_MIDDLE
    oak: str = OAK
    months: str = MONTHS
    years: str = YEARS
    ageing: str = AGEING
    aroma: dict = field(default_factory=lambda: AROMA)
    food: dict = field(default_factory=lambda: FOOD)
    pairing: str = PAIRING
    serve: str = SERVE
    alcohol: list = field(default_factory=lambda: ALCOHOL)
    grapes: dict = field(default_factory=lambda: GRAPES)
    not_grapes: list = field(default_factory=lambda: NOT_GRAPES)


RUSSIAN = Lexicon()
