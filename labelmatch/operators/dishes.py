"""Rules that read a dish from a message. Name, pattern, axes, tags (and change of intensity)."""

# ---- fixed values -------------------------------------------------------------------------
MAIN = [
    ("стейк/говядина", r"стейк|говядин|антрекот|рибай|рибэй|вырезк|мраморн|бифштекс|тартар", dict(intensity=3.5, fat=3, salt=1.5), ["красное мясо"]),
    ("баранина", r"баранин|ягнен|ягнят|каре ягн|бараньи", dict(intensity=3.7, fat=3.2, salt=1.5), ["красное мясо", "баранина"]),
    ("шашлык/гриль", r"шашлык|мангал|гриль|барбекю|на углях|люля|кебаб", dict(intensity=3.3, fat=3, salt=2, heat=1), ["красное мясо", "гриль"]),
    ("дичь", r"дичь|оленин|кабан|перепел|фазан|заяц|кролик|лось", dict(intensity=3.6, fat=2, salt=1.5), ["красное мясо", "дичь"]),
    ("утка", r"утк|утин|гусь", dict(intensity=3.0, fat=3.5, salt=1.5), ["птица", "утка"]),
    ("свинина", r"свинин|карбонад|рулька|ребра|ребрышк|бекон|сало|шейк", dict(intensity=2.8, fat=3.2, salt=2), ["свинина"]),
    ("курица/индейка", r"куриц|курин|цыпл|индейк|птиц|чахохбили|табака", dict(intensity=2, fat=1.5, salt=1.5), ["птица"]),
    ("паштет/фуа-гра", r"фуа|паштет|печен(ь|ка|ки)\b", dict(intensity=3, fat=4, salt=2, sweet=0), ["жирное", "печень"]),
    ("колбаса/мясная нарезка", r"колбас|сосиск|прошутто|хамон|ветчин|мясная нарезк|мясное ассорти|буженин|салями|карпаччо", dict(intensity=2.5, fat=3, salt=3.5), ["мясная нарезка"]),
    ("плов", r"плов|бешбармак|манты|хинкали|долма|лагман|чебурек", dict(intensity=2.8, fat=3, salt=2, heat=0.5), ["красное мясо"]),
    ("борщ/суп", r"борщ|(?<!\w)суп|солянк|харчо|(?<!\w)щи\b|(?<!\w)уха\b|окрошк", dict(intensity=2.5, fat=2, acid=1.5, salt=2), []),
    ("пельмени/пироги", r"пельмен|вареник|пирог|пирожк|блин|запеканк", dict(intensity=2.3, fat=2, salt=1.5), []),
    ("паста", r"паст[аыу]|спагетти|макарон|феттуч|пенне|тальятелле|болоньез|карбонар|лазань|ризотто", dict(intensity=2.3, fat=2, salt=1.5), ["паста"]),
    ("пицца", r"пицц", dict(intensity=2.5, fat=2.5, acid=2, salt=2.5), ["паста", "сыр"]),
    ("бургер/фастфуд", r"бургер|фастфуд|картошка фри|хот-дог|шаурм|наггетс", dict(intensity=2.8, fat=3.3, salt=3, acid=1), []),
    ("устрицы", r"устриц", dict(intensity=1.3, fat=0.5, acid=1, salt=3), ["морепродукты", "минеральное"]),
    ("морепродукты", r"морепродукт|креветк|мидии|мидий|краб|кальмар|гребешк|лобстер|омар|осьминог|рапан", dict(intensity=1.8, fat=1, salt=2.5), ["морепродукты"]),
    ("белая рыба", r"треск|судак|дорад|сибас|камбал|палтус|(?<!\w)сом\b|белая рыба|окун|хек|минтай|барамунд", dict(intensity=1.7, fat=1, salt=1.5), ["рыба"]),
    ("жирная рыба", r"лосос|семг|форел|тунец|осетр|скумбри|угорь|сельд|селедк|копчен\w+ рыб|стерлядь|кета", dict(intensity=2.6, fat=3, salt=2.5), ["рыба", "жирное"]),
    ("рыба", r"рыб", dict(intensity=2, fat=1.5, salt=2), ["рыба"]),
    ("суши", r"суши|роллы|сашими|ролл", dict(intensity=1.8, fat=1.5, salt=3, acid=1.5), ["рыба", "азиатская"]),
    ("сыр мягкий", r"камамбер|(?<!\w)бри\b|мягкий сыр|моцарелл|буррат|рикотт|фета|брынз|сулугуни|адыгейск|творожн\w+ сыр|сливочн\w+ сыр|козий сыр", dict(intensity=2, fat=2.7, salt=2.5, acid=1), ["сыр"]),
    ("сыр твёрдый", r"пармезан|чеддер|гауда|твердый сыр|выдержанный сыр|грюйер|маасдам|эмменталь|российский сыр|сыр", dict(intensity=3, fat=3, salt=3), ["сыр"]),
    ("сыр с плесенью", r"дорблю|рокфор|горгонзол|с плесенью|голубой сыр|блю чиз", dict(intensity=3.8, fat=3, salt=4), ["сыр", "сыр с плесенью"]),
    ("грибы", r"гриб|шампиньон|лисичк|белые грибы|трюфел|жульен", dict(intensity=2.5, fat=1.8, salt=1.5), ["грибы"]),
    ("салат", r"салат|овощ|зелен|рукола|огурц|помидор|томат|капуст|цезарь|греческ", dict(intensity=1.2, fat=1, acid=2, salt=1.5), ["овощи"]),
    ("овощи гриль/запечённые", r"баклажан|кабачок|овощи на гриле|цукини", dict(intensity=2, fat=1.5, salt=1.5), ["овощи"]),
    ("закуски", r"закуск|канапе|тапас|орешк|оливк|бутерброд|брускетт|нарезк", dict(intensity=1.7, fat=1.5, salt=3), ["закуски"]),
    ("яйца/омлет", r"омлет|яичниц|яйцо|яйца|киш|фритата|бенедикт", dict(intensity=1.7, fat=2.3, salt=1.5), []),
    ("азиатское острое", r"карри|том-ям|том ям|тайск|сычуан|кимчи|вок|пад тай|азиатск", dict(intensity=3, fat=2, salt=2.5, heat=3), ["азиатская", "острое"]),
    ("десерт", r"десерт|торт|пирожн|чизкейк|тирамису|мороженое|пломбир|штрудель|эклер|панна котта|фондан|брауни|пирожное|варенье|пахлав", dict(intensity=2.5, fat=2, sweet=2.8), ["десерт"]),
    ("шоколад", r"шоколад|трюфель|конфет", dict(intensity=3, fat=2.5, sweet=2.5), ["десерт", "шоколад"]),
    ("фрукты", r"фрукт|ягод|яблок|груш|виноград|дыня|арбуз|персик|клубник|цитрус|апельсин", dict(intensity=1.5, fat=0, acid=1.5, sweet=2), ["фрукты", "десерт"]),
    ("орехи/сухофрукты", r"орех|миндал|сухофрукт|курага|инжир", dict(intensity=2.2, fat=2.5, sweet=1), []),
]
MODIFIERS = [
    ("острый соус/перец", r"остр(ый|ая|ое|ые|ым|ой|о)\b|перчик|чили|аджик|табаско|харисса|васаби|хрен|горчиц|шрирача", dict(heat=3), ["острое"], 0.4),
    ("ягодный/фруктовый соус", r"вишневым|вишн\w+ соус|ягодн\w+ (соус|чатни)|брусничн|клюквенн|чатни|конфитюр|фруктов\w+ соус|апельсинов\w+ соус|медово|медом|карамел|терияки|кисло-сладк|сладкий соус|сладким соус", dict(sweet=1.0, acid=1.5), ["сладко-кислый"], 0.2),
    ("перечный соус", r"перечн\w+ соус|под перц|в перц|черн\w+ перц", dict(heat=1.8), ["перец"], 0.3),
    ("сливочный соус", r"сливочн\w+ (соус|крем)|в сливках|альфредо|бешамель|крем-суп|сметан", dict(fat=3), ["жирное"], 0.0),
    ("томатный соус", r"томатн\w+ (соус|подлив)|в томат|болоньез|маринар|кетчуп|сацив", dict(acid=2.5), ["томатное"], 0.0),
    ("лимон/уксус", r"лимон|лайм|уксус|маринад|маринован|соус цитрус|цитрусов\w+ соус|севиче|цевиче", dict(acid=3), ["кислое"], -0.2),
    ("соевый/солёное", r"соев|солен|засолен|копчен|вялен|анчоус|маслин|каперс", dict(salt=3.5), ["солёное"], 0.1),
    ("гриль/копчение", r"на гриле|на мангале|на углях|копчен|жарен\w* на|обжарен|фламбе|барбекю", dict(fat=0), ["гриль"], 0.4),
    ("тушёное/долгое", r"тушен|рагу|жаркое|запечен|томлен|конфи|брейз|осссобуко|осбуко", dict(fat=2.5), ["тушёное"], 0.4),
    ("жареное/фритюр", r"жарен|фритюр|темпура|кляр|панировк|во фритюре|хрустящ", dict(fat=3), ["жареное"], 0.2),
    ("на пару/варёное", r"на пару|варен|отварн|припущен|пашот", dict(fat=0), ["нежное"], -0.3),
    ("сырое/тартар", r"сыр(ая|ой|ое|ые) (рыб|говядин)|тартар|карпаччо|севиче|сашими", dict(fat=0), ["сырое"], -0.3),
    ("пряности/специи", r"пряност|специ|карри|зира|кориандр|паприк|имбир|куркум|гвоздик|корица", dict(heat=1.5), ["пряное"], 0.2),
    ("травы/зелень", r"с травами|зелень|базилик|тимьян|розмарин|чабрец|петрушк|кинза|мят", dict(), ["травы"], 0.0),
    ("грибной соус", r"грибн\w+ соус|в грибах|с грибами|с белыми", dict(), ["грибы"], 0.2),
    ("чеснок/лук", r"чеснок|лук\b|луков", dict(salt=0.5), [], 0.0),
]
#: A general dish goes where one of these stands beside it, unless its own words do.
GENERAL = {"рыба": (["белая рыба", "жирная рыба", "суши", "устрицы", "морепродукты"], None), "сыр твёрдый": (["сыр мягкий", "сыр с плесенью", "пицца", "паста"], r"пармезан|чеддер|гауда|твердый|грюйер|выдержанный")}
#: A modifier that makes a dish by itself, the tag of great heat, and the tag that makes the course.
ALONE, HOT_TAG, DESSERT_TAG = "острый соус/перец", "острое", "десерт"
CUISINES = [
    ("Дагестан", r"дагестанск|курзе|хинкал|аварск"),
    ("Северная Осетия — Алания", r"осетинск|осетин\w+ пирог"),
    ("Долина Дона", r"донск|казачь|казачий|раки|сазан|тарань"),
    ("Кубань", r"кубанск|кубань|борщ кубан|краснодар"),
    ("Крым", r"крымск|крым\b|чебурек|севастопол|татарск"),
    ("Ставрополье", r"ставропол"),
]
STYLES = {
    "кавказская": r"кавказск|грузинск|хинкали|хачапур|шашлык|чахохбили|лобио|сациви|аджик|армянск|азербайдж",
    "средиземноморская": r"итальянск|средиземномор|паста|пицц|ризотто|греческ|испанск|тапас|французск",
    "азиатская": r"азиатск|японск|тайск|китайск|корейск|индийск|карри|суши|вок",
}
COURSES = [
    ("аперитив", r"аперитив|перед ужином|для встречи|до еды|без еды|вместо аперитива|встреч\w+ гост|фуршет"),
    ("десерт", r"к десерту|на десерт|после ужина|десерт"),
    ("основное", r"основн\w+ блюд|горячее|на ужин|на обед"),
    ("закуска", r"закуск|нарезк|сырн\w+ тарелк|сырная тарелка|антипасти"),
]
TYPICAL = [
    ("Стейк", "стейк"), ("Баранина", "баранина"), ("Шашлык", "шашлык"), ("Дичь", "оленина"), ("Утка", "утка"), ("Свинина", "свинина"), ("Курица, индейка", "курица"),
    ("Паштет", "паштет"), ("Мясная нарезка", "мясная нарезка"), ("Плов", "плов"), ("Паста", "паста"), ("Пицца", "пицца"), ("Устрицы", "устрицы"), ("Морепродукты", "креветки"),
    ("Белая рыба", "сибас"), ("Лосось", "лосось"), ("Суши", "суши"), ("Мягкий сыр", "камамбер"), ("Твёрдый сыр", "пармезан"), ("Сыр с плесенью", "дорблю"), ("Грибы", "грибы"),
    ("Салат", "салат"), ("Овощи гриль", "баклажаны"), ("Закуски", "закуски"), ("Острое азиатское", "карри"), ("Десерт", "десерт"), ("Шоколад", "шоколад"), ("Фрукты", "фрукты"),
]
#: dish tag, aromas that complement it, aromas that contrast with it.
AROMA_LINKS = [
    (["грибы"], ["землистое/грибное", "орехи"], []),
    (["баранина"], ["травы/зелень", "пряности/перец"], []),
    (["красное мясо", "гриль"], ["дым/смола", "пряности/перец", "тёмные ягоды"], []),
    (["утка"], ["красные ягоды"], []),
    (["сладко-кислый"], ["красные ягоды", "тёмные ягоды"], []),
    (["морепродукты"], ["минеральность"], ["цитрус"]),
    (["рыба"], ["минеральность"], ["цитрус"]),
    (["сыр с плесенью"], [], ["мёд", "сухофрукты"]),
    (["десерт"], ["косточковые", "мёд", "тропические", "сухофрукты", "красные ягоды"], []),
    (["шоколад"], ["шоколад/кофе", "тёмные ягоды", "сухофрукты"], []),
    (["овощи"], ["травы/зелень"], ["цитрус"]),
    (["острое"], [], ["тропические", "косточковые", "цветы"]),
]
FOOD_TAGS = {
    "красное мясо": "красное мясо", "баранина": "красное мясо", "гриль": "красное мясо", "дичь": "красное мясо", "птица": "птица", "утка": "птица", "свинина": "свинина",
    "рыба": "рыба", "морепродукты": "морепродукты", "сыр": "сыр", "десерт": "десерт", "фрукты": "десерт", "шоколад": "десерт", "закуски": "закуски", "паста": "паста/пицца",
    "овощи": "овощи/салат", "грибы": "овощи/салат", "острое": "острое/азиатская", "азиатская": "острое/азиатская",
}
COLORS = [
    ("Красное", r"красн\w+", "красн"),
    ("Белое", r"бел(ое|ого|ым|ом|ые|ых)\b", "бел"),
    ("Розовое", r"розов\w+|розе\b|rose\b", "розов"),
    ("Оранжевое", r"оранжев\w+|orange\b|апельсиновое вино|с мацерацией|скин-контакт", "оранжев"),
]
SWEET_WISHES = [
    ([0], r"(?<!не )(?<!полу)\bсух(ое|ого|ое вино|им)\b|только сух|люблю сух|без сахара|\bбрют\b"),
    ([0, 1], r"не сладк\w+|несладк\w+|не люблю сладк\w+|без сладост\w*|поменьше сахар"),
    ([2], r"полусладк\w+"),
    ([3], r"(?<!полу)\bсладк(ое|ого|им|ое вино)\b|десертн\w+ вин|люблю сладк"),
    ([1], r"полусух\w+"),
]
OCCASIONS = [
    ("celebration", r"годовщин|праздн|день рожден|юбилей|новый год|свадьб|отмечаем|отпраздн|повод|торжеств"),
    ("aperitif", r"аперитив|встреч\w+ гост|перед ужином|фуршет"),
    ("date", r"свидани|романтическ|вдвоем|с партнер|с девушк|с парнем|с женой|с мужем"),
    ("business", r"деловая|деловой|переговор|партнеры по бизнесу|клиент|коллег|корпоратив"),
    ("gift", r"подарок|в подарок|подарить|дарим"),
    ("family", r"семейн|с семьей|с родител|с родственник"),
    ("casual", r"просто так|посидеть|пятниц|будни|после работы|расслаб"),
]
FIZZ, NO_FIZZ = r"игрист|шампанск|пузырьк|брют|просекко|cremant|креман", r"не (?:люблю|хочу|надо) (игрист|пузырьк|шампанск)|без пузырьк"
AVOIDED = [r"не люблю ([^.,;!?]*)", r"без ([^.,;!?]*)", r"кроме ([^.,;!?]*)", r"не хочу ([^.,;!?]*)"]
NO_OAK = r"не люблю дуб|без дуба|без бочк|не люблю бочк|без ванил|не люблю ванил|не хочу дуб|без бариков|невыдержанн|не выдержанн"
TANNIN_WISHES = [("low", r"не люблю танин|без танин|мало танин|мягк\w+ танин|не терпк|без терпкост|не вяжущ|не люблю вяжущ"), ("high", r"люблю танинн|танинн\w+ (красн|вин)|терпк|вяжущ|побольше танин")]
LIGHT, LIGHT_FOOD, FULL = r"легк\w+|нетяжел|не тяжел|питк|полегче|воздушн", r"легк\w+ (закуск|салат|ужин|блюд)", r"плотн\w+ вин|мощн\w+ вин|насыщенн\w+ вин|полнотел|погуще"
BUDGET = r"(до|около|не дороже|не более|в пределах)\s*(\d[\d\s]*)\s*(руб|₽|р\b|т\.?р)|недорог\w+|не сильно дорого|бюджетн\w+|подороже|премиум|дорог\w+"
EXPERIENCE = [("expert", r"терруар|танинн\w+ структур|винтаж|кюве|ассамбляж|мацерац|бариков|минеральн\w+ тон|послевкус|аппелясьон|урожа[йя]"), ("novice", r"ничего не понимаю|не разбираюсь|новичок|первый раз|впервые|проще|простыми словами|просто\b.*вино|что такое")]
NAMED_REGIONS = [("Долина Дона", r"донск|долина дона")]
BUDGET_NOTE = "budget_unsupported"
# ---- end of fixed values ------------------------------------------------------------------
