"""Closed-class words of seven languages, written for this library."""


def _w(text: str) -> frozenset[str]:
    return frozenset(text.split())


DATA: dict[str, dict] = {
    "eng": {
        "iso1": "en", "name": "English",
        "function_words": _w("""a about above after again against all also am an and any are as at be because been before being below between both but by can could did do
            does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me
            might more most must my myself no nor not now of off on once only or other our ours out over own same shall she should so some such than that the their
            theirs them themselves then there these they this those through to too under until up upon us very was we were what when where which while who whom why
            will with within without would you your yours please really actually basically"""),
        "negations": _w("not no never none nothing nor neither cannot can't don't doesn't didn't won't isn't aren't wasn't without"),
        "generic": _w("thing things stuff way ways lot lots kind sort bit make makes made making get gets got getting go goes going went put take takes took use used"),
        "verbs": {"run": ("runs", "running", "ran"), "write": ("writes", "writing", "wrote", "written"), "find": ("finds", "finding", "found"), "build": ("builds", "building", "built"), "show": ("shows", "showing", "showed", "shown"), "give": ("gives", "giving", "gave", "given"), "want": ("wants", "wanted", "wanting"), "need": ("needs", "needed", "needing"), "know": ("knows", "knew", "known"), "think": ("thinks", "thought", "thinking"), "send": ("sends", "sent", "sending"), "call": ("calls", "called", "calling")},
        "lemmas": {"documents": "document", "children": "child", "invoices": "invoice", "reports": "report", "better": "good", "men": "man", "women": "woman", "cars": "car", "tests": "test", "errors": "error", "files": "file", "words": "word"},
        "names": _w("london paris rome berlin madrid europe america google microsoft python monday friday"),
        "adverbs": _w("really quickly slowly soon often always"), "modifiers": _w("quickly slowly really very new old good bad"),
    },
    "fra": {
        "iso1": "fr", "name": "French",
        "function_words": _w("""à au aux avec ce ces cet cette comme dans de des du elle elles en est et eux il ils je la le les leur leurs lui ma mais me même mes moi mon
            ne nos notre nous on ont ou où par pas pour qu que quel quelle qui sa sans se ses si son sont sur ta te tes toi ton tu un une vos votre vous été être
            avoir fait plus très aussi donc car y"""),
        "negations": _w("ne pas non jamais rien aucun aucune personne sans ni"),
        "generic": _w("chose choses truc faire fait fais aller va prendre mettre"),
        "verbs": {"écrire": ("écrit", "écrivons", "écrivent", "écris"), "trouver": ("trouve", "trouvé", "trouvons"), "donner": ("donne", "donné", "donnent"), "parler": ("parle", "parlé", "parlent")},
        "lemmas": {"documents": "document", "enfants": "enfant", "maisons": "maison", "factures": "facture", "yeux": "œil"}, "names": _w("paris lyon france europe"),
    },
    "deu": {
        "iso1": "de", "name": "German",
        "function_words": _w("""aber als am an auch auf aus bei bin bis da dann das dass dem den der des die dies diese dieser doch du durch ein eine einem einen einer eines
            er es für hat haben hatte ich ihr im in ist ja kann man mehr mein mit nach nicht noch nun nur ob oder ohne sein sich sie sind so über um und uns unter
            vom von vor war was wenn werden wie wir wird zu zum zur zwischen"""),
        "negations": _w("nicht nie kein keine keinen keiner niemals nichts ohne weder"),
        "generic": _w("ding dinge sache sachen machen macht gemacht gehen geht tun tut"),
        "verbs": {"schreiben": ("schreibt", "schrieb", "geschrieben"), "finden": ("findet", "fand", "gefunden"), "geben": ("gibt", "gab", "gegeben"), "sehen": ("sieht", "sah", "gesehen")},
        "lemmas": {"häuser": "haus", "kinder": "kind", "rechnungen": "rechnung", "bücher": "buch"}, "names": _w("berlin münchen deutschland europa"),
    },
    "spa": {
        "iso1": "es", "name": "Spanish",
        "function_words": _w("""a al algo ante antes aquí así aun aunque bien cada como con contra cual cuando de del desde donde dos e el él ella ellas ellos en entre era es
            esa ese eso esta está estas este esto estos fue ha hasta hay la las le les lo los más me mi mis mucho muy ni no nos o os otra otro para pero poco por
            porque que qué quien se ser si sí sin sobre son su sus también te tu tus un una uno y ya yo"""),
        "negations": _w("no nunca jamás nada nadie ningún ninguna ni sin tampoco"),
        "generic": _w("cosa cosas hacer hace hecho ir va poner tener"),
        "verbs": {"escribir": ("escribe", "escrito", "escriben"), "encontrar": ("encuentra", "encontrado", "encuentran"), "dar": ("da", "dado", "dan"), "hablar": ("habla", "hablado", "hablan")},
        "lemmas": {"casas": "casa", "niños": "niño", "facturas": "factura", "libros": "libro"}, "names": _w("madrid barcelona españa europa"),
    },
    "ita": {
        "iso1": "it", "name": "Italian",
        "function_words": _w("""a ad ai al alla alle anche ancora avere che chi ci come con cui da dal dalla dei del della delle di dove e ed era essere gli ha hanno ho i il in
            io la le lei li lo loro lui ma mi mia mio ne nei nel nella noi o per perché più quale quando quella quello questa questo qui se si sia sono su sua
            sul suo tra tu un una uno vi voi"""),
        "negations": _w("non mai niente nulla nessuno nessuna né senza"),
        "generic": _w("cosa cose fare fa fatto andare va mettere"),
        "verbs": {"scrivere": ("scrive", "scritto", "scrivono"), "trovare": ("trova", "trovato", "trovano"), "dare": ("dato", "danno", "dà"), "parlare": ("parla", "parlato", "parlano")},
        "lemmas": {"case": "casa", "bambini": "bambino", "fatture": "fattura", "libri": "libro"}, "names": _w("roma milano italia europa"),
    },
    "por": {
        "iso1": "pt", "name": "Portuguese",
        "function_words": _w("""a ao aos as até com como da das de dela dele deles depois do dos e ela elas ele eles em entre era essa esse esta está este eu foi foram há isso
            isto já lhe mais mas me mesmo meu minha muito na nas nem no nos nós o os ou para pela pelo por qual quando que quem são se sem ser seu sua suas só
            também te tem um uma você vocês"""),
        "negations": _w("não nunca jamais nada ninguém nenhum nenhuma nem sem"),
        "generic": _w("coisa coisas fazer faz feito ir vai pôr"),
        "verbs": {"escrever": ("escreve", "escrito", "escrevem"), "falar": ("fala", "falado", "falam")},
        "lemmas": {"casas": "casa", "crianças": "criança", "faturas": "fatura"}, "names": _w("lisboa brasil portugal europa"),
    },
    "zho": {
        "iso1": "zh", "name": "Chinese",
        "function_words": _w("的 了 和 是 在 也 都 就 而 及 与 着 或 一个 我们 你们 他们 这 那 有 被 把 对 从 到 吗 呢 吧"),
        "negations": _w("不 没 没有 别 无 未 非"), "generic": _w("东西 事情"),
    },
}

#: Words that the Han segmenter knows.
HAN = _w("中国 北京 世界 人民 我们 你们 他们 今天 明天 天气 很好 学习 学生 大学 北京大学 计算机 计算 机器 机器学习 语言 模型 语言模型 自然 自然语言 自然语言处理 处理 数据 数据库 分析 系统 文本 压缩 没有 一个 东西 事情")
