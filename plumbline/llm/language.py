"""Naive Bayes over character n-grams: the language of pieces of text."""

from __future__ import annotations

import numpy as np

BUCKETS = 1 << 15

# The sentences that the model is trained on, by language.
SEEDS: dict[str, str] = {
    "zh": "这个问题要先看现场情况再决定怎么处理。建议您先联系师傅检查一下墙面和地面，确认没有问题之后再开始施工。合同里写清楚付款方式和保修责任，验收的时候把单据都留好。我们家的厨房和卫生间都做了防水，闭水试验两天没有渗漏。价格可以多问几家，不要只看便宜，材料的厚度和品牌也很重要。客厅的瓷砖出现空鼓，多半是基层没有清理干净。如果温度太低，涂料就不容易干，要等几天才能刷第二遍。您好，请问卧室的插座应该装在什么位置比较合适？窗户关不严的话会漏风，可以换密封条。水管接头在打压的时候不应该有水滴出来。",
    "en": "You should ask the contractor to check the wall before the floor is laid. The tiles were loose because the mortar had not dried, and the joints must be sealed again. How much does it cost to paint a room, and which brand would you choose? Keep the receipt and the test report together; they are needed for the warranty. If there is water under the sink, then turn off the valve and call a plumber. We measured the height of the window with a level, and it was not straight. Do not pay the whole amount until the work is finished. Is this a good price for a kitchen cabinet with three doors? Leave a gap between the panel and the frame. Most of the cracks come from the change of temperature in winter.",
    "es": "Hay que revisar la pared antes de poner el suelo, porque la mezcla todavía no está seca. El precio de la puerta es demasiado alto y el proveedor no quiere cambiarla. ¿Cuánto cuesta pintar una habitación y qué marca es mejor? Si la junta tiene agua, es necesario cerrar la llave y llamar al fontanero. Guarde el recibo con el informe de la prueba para la garantía. Después de tres días se puede poner la segunda capa. La cocina y el baño llevan azulejos nuevos desde el año pasado. No pague todo hasta que la obra esté terminada. Según el plano, la ventana mide dos metros y por eso no cabe. Los muebles que compramos eran de madera y costaron mucho.",
    "fr": "Il faut vérifier le mur avant de poser le sol, car le mortier n'est pas encore sec. Le prix de la porte est trop élevé et le fournisseur ne veut pas la changer. Combien coûte la peinture d'une chambre et quelle marque est la meilleure ? Si le joint laisse passer de l'eau, fermez le robinet et appelez le plombier. Gardez la facture avec le rapport d'essai pour la garantie. Après trois jours, vous pouvez passer la deuxième couche. La cuisine et la salle de bain ont de nouveaux carreaux depuis l'année dernière. Ne payez pas tout avant que les travaux soient terminés. Selon le plan, la fenêtre mesure deux mètres.",
    "de": "Man muss die Wand prüfen, bevor der Boden verlegt wird, weil der Mörtel noch nicht trocken ist. Der Preis der Tür ist zu hoch und der Lieferant will sie nicht tauschen. Was kostet es, ein Zimmer zu streichen, und welche Marke ist die beste? Wenn die Fuge Wasser durchlässt, schließen Sie den Hahn und rufen Sie den Klempner. Bewahren Sie die Rechnung mit dem Prüfbericht für die Garantie auf. Nach drei Tagen kann die zweite Schicht aufgetragen werden. Die Küche und das Bad haben seit letztem Jahr neue Fliesen. Zahlen Sie nicht alles, bis die Arbeit fertig ist. Nach dem Plan ist das Fenster zwei Meter breit.",
    "pt": "É preciso verificar a parede antes de colocar o piso, porque a massa ainda não está seca. O preço da porta é muito alto e o fornecedor não quer trocar. Quanto custa pintar um quarto e qual é a melhor marca? Se a junta tem água, feche a torneira e chame o encanador. Guarde o recibo com o relatório do teste para a garantia. Depois de três dias você pode passar a segunda demão. A cozinha e o banheiro têm azulejos novos desde o ano passado. Não pague tudo até que a obra esteja terminada. Segundo o projeto, a janela mede dois metros.",
    "it": "Bisogna controllare il muro prima di posare il pavimento, perché la malta non è ancora asciutta. Il prezzo della porta è troppo alto e il fornitore non vuole cambiarla. Quanto costa dipingere una camera e quale marca è la migliore? Se il giunto perde acqua, chiudete il rubinetto e chiamate l'idraulico. Conservate la fattura con il rapporto di prova per la garanzia. Dopo tre giorni si può dare la seconda mano. La cucina e il bagno hanno piastrelle nuove dall'anno scorso. Non pagate tutto finché i lavori non sono finiti.",
    "ja": "床を張る前に壁を確認する必要があります。下地がまだ乾いていないので、三日ほど待ってから次の作業に進んでください。ドアの値段が高すぎますが、業者は交換してくれません。部屋の塗装はいくらかかりますか、どのメーカーがいいでしょうか。目地から水が漏れる場合は、栓を閉めて水道屋さんに連絡しましょう。保証のために領収書と検査の記録を一緒に保管しておくと安心です。台所と浴室のタイルは去年新しくしました。工事が終わるまで全額を払わないでください。図面によると窓の幅は二メートルで、そのまま取り付けることはできませんでした。",
    "ko": "바닥을 깔기 전에 벽을 확인해야 합니다. 모르타르가 아직 마르지 않았기 때문에 사흘 정도 기다려야 합니다. 문 가격이 너무 비싸지만 업체가 바꿔 주지 않습니다. 방을 칠하는 데 얼마나 들고 어떤 브랜드가 좋을까요? 이음새에서 물이 새면 밸브를 잠그고 배관공에게 연락하세요. 보증을 위해 영수증과 시험 보고서를 함께 보관하세요. 부엌과 욕실의 타일은 작년에 새로 했습니다. 공사가 끝날 때까지 전액을 지불하지 마세요.",
    "ru": "Перед укладкой пола нужно проверить стену, потому что раствор ещё не высох. Цена двери слишком высокая, и поставщик не хочет её менять. Сколько стоит покрасить комнату и какая марка лучше? Если шов пропускает воду, закройте кран и позвоните сантехнику. Храните чек вместе с протоколом испытаний для гарантии. Через три дня можно наносить второй слой. На кухне и в ванной новая плитка с прошлого года. Не платите всё, пока работа не закончена.",
}
LANGUAGES = sorted(SEEDS)

# What ends a piece of text, as code points.
_ENDS = np.array(sorted(map(ord, "。！？；!?;\n.：:")), np.uint32)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the index of each one's text."""
    n = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.repeat(np.arange(len(texts)), n)


def _letters(c: np.ndarray) -> np.ndarray:
    return ((c >= 97) & (c <= 122)) | ((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c < 0x2000)) | ((c >= 0x3040) & (c < 0xFB00)) | (c >= 0x20000)


# First code points of the blocks of scripts: Latin, Greek, Cyrillic, others, kana, Han, Hangul, others.
_SCRIPTS = np.array([0, 0x370, 0x400, 0x530, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00], np.uint32)


def _grams(c: np.ndarray, piece: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 to 3: bucket and place of each n-gram that lies in one piece; last, the scripts of the letters."""
    x = np.where((c >= 65) & (c <= 90), c + 32, c).astype(np.uint64)
    x = np.where(_letters(c), x, np.uint64(32))
    out = []
    for n in (1, 2, 3):
        h = np.full(max(0, len(x) - n + 1), n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ x[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        inside = (piece[: len(h)] == piece[n - 1 :][: len(h)]) & (x[: len(h)] != 32)
        place = np.flatnonzero(inside)
        out.append((((h[place] >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), place))
    place = np.flatnonzero(x != 32)
    out.append((np.searchsorted(_SCRIPTS, c[place], side="right"), place))
    return out


class LanguageModel:
    """Multinomial naive Bayes with equal priors and add-``alpha`` smoothing, trained on ``seeds``."""

    def __init__(self, seeds: dict[str, str] | None = None, alpha: float = 0.05) -> None:
        seeds = seeds or SEEDS
        self.languages = sorted(seeds)
        self.table = np.zeros((4, len(self.languages), BUCKETS), np.float32)
        for k, lang in enumerate(self.languages):
            c, piece = codes([seeds[lang]])
            for n, (bucket, _) in enumerate(_grams(c, piece)):
                count = np.bincount(bucket, minlength=BUCKETS) + alpha
                self.table[n, k] = np.log(count / count.sum())
        self.table -= self.table.mean(axis=1, keepdims=True)

    def shares(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): the share of each text's letters that lies in pieces whose most probable language it is.

        A piece ends at a full stop, question or exclamation mark, semicolon, colon or line end, and where East Asian letters
        and others meet, so that a foreign name is a piece by itself. East Asian letters count two and a half times. Texts
        without letters have zeros.
        """
        c, doc = codes(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(c):
            return out
        new = np.r_[True, (doc[1:] != doc[:-1]) | np.isin(c[:-1], _ENDS)]
        at = np.flatnonzero(_letters(c))
        wide = (c[at] >= 0x3040) & (c[at] < 0xFB00)
        new[at[1:][wide[1:] != wide[:-1]]] = True
        piece = np.cumsum(new) - 1
        score = np.zeros((len(self.languages), piece[-1] + 1), np.float32)
        for n, (bucket, place) in enumerate(_grams(c, piece)):
            if not len(place):
                continue
            at = piece[place]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            for k, row in enumerate(self.table[n]):
                score[k, at[start]] += np.add.reduceat(row[bucket], start)
        weight = np.bincount(piece, np.where(_letters(c), np.where((c >= 0x3040) & (c < 0xD7B0), 2.5, 1.0), 0.0), minlength=score.shape[1])
        best = doc[new] * len(self.languages) + score.argmax(axis=0)
        out = np.bincount(best, weight, minlength=out.size).reshape(out.shape)
        total = out.sum(axis=1, keepdims=True)
        return np.divide(out, total, out=out, where=total > 0)
