"""Inspection of representatives' names by rule: what is no name goes, what is around a name is cut off.

Each distinct name is brought into its normal forms and looked through for fixed words by one automaton;
``inspect_names`` does this once for each distinct name and joins back. Word lists are parameters of
``Rules``; the defaults hold words of general use, and a list of one's own (``extra_words``) adds others, such
as headings of single sites.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meibo.operators.filters import not_blank
from meibo.schema import PREFECTURES

# Fixed values, down to Rules: posts, and forms of address that stand after a name.
TITLES = (
    "代表取締役会長CEO", "代表取締役社長COO", "代表取締役副社長", "代表取締役専務", "代表取締役常務", "代表取締役", "取締役会長", "取締役社長", "取締役副社長", "取締役専務", "取締役常務", "取締役",
    "代表理事", "代表", "会長", "社長", "副社長", "専務", "常務", "執行役員", "監査役", "理事長", "院長", "所長", "支店長", "本部長", "部長", "課長", "店長", "工場長", "センター長", "室長",
    "主任", "係長", "担当役員", "担当者", "担当", "責任者", "マネージャー",
)
AFTER = ("様", "さん", "氏")
OFFICERS = ("CEO", "COO", "CFO", "CTO", "CMO")
NOISE_TOKENS = ("男性", "女性", "男", "女", "担当", "担当者", "責任者", "窓口", "受付", "御中", "様", "さん", "氏", "代表", "社長", "会長")
# words that are no name as a whole
NOT_NAMES = (
    "不明", "ふめい", "未定", "なし", "無し", "該当なし", "担当者不明", "代表者不明", "各位", "御中", "一同", "あいさつ", "ごあいさつ", "御挨拶", "挨拶", "ご挨拶", "問候", "致辞", "company",
    "兼社長 CEO", "兼CEO", "関連ページ", "BACK", "各種ダウンロード", "CEO", "グループCEO", "企業行動規範", "講話", "ページTOPへ", "安全管理措置", "CORPORATE IDENTITY", "あいさつ全文を見る",
    "院長挨拶", "変更 挨拶", "交代の挨拶", "交代のご挨拶", "退任 就任のご挨拶", "就任のご挨拶", "就任のお知らせ", "交代のお知らせ", "交代", "就任", "所在地", "本社所在地", "本社住所", "本社",
    "本店所在地", "住所", "電話", "TEL", "TEL FAX", "FAX", "メール", "アドレス", "営業時間", "資本金", "従業員数", "従業員", "社員数", "社員", "業種", "業務内容", "社名", "採用担当者名",
    "記入担当者", "出店地域", "仕様", "約款", "適用範囲", "管理本部", "監査等", "研修", "認定等", "株式上場", "株主総会", "上場", "創立", "所信", "グループ", "職名 理事長 氏名",
    "職名 代表取締役 氏名", "最高経営責任者", "Chief executive officer", "運営責任者", "取缔役社长", "取缔役 社长", "NEWS", "Home", "home", "HOME", "ホーム", "TOP", "総合TOP", "BLOG", "Blog",
    "ブログ", "ブログを見る", "ブログを読む", "COMPANY", "Company", "COMPANY PROFILE", "Company overview", "HISTORY", "OUTLINE", "PRODUCTS", "PRESIDENT", "GREETING", "MESSAGE", "Message",
    "Time Table", "サイトマップ", "ページの先頭へ戻る", "ボタンテキスト", "テキスト", "タイトルイメージ", "プロフィール", "経歴", "インタビュー", "コメント", "資格", "メッセージと企業ビジョン",
    "メッセージを見る", "副社長メッセージ", "総合職採用", "医師", "博士", "症例", "質問", "未来", "入社", "出身地", "親族", "実印 角印", "及びスタッフ一同", "社員一同", "私たちの価値観", "クラス",
    "生活相談員", "ソーシャルワーカー", "報告", "コミットメント", "一筆", "略歴", "経営会議", "環境管理責任者", "カナ", "構成員", "委員", "コラム", "日記", "兼グループ", "三代目", "问候",
)
#: Headings of greetings, and what may stand after one, parted by a space or a dot.
GREETINGS = ("あいさつ", "ごあいさつ", "ご挨拶", "挨拶", "メッセージ")
GREETED = (
    "greeting", "GREETING", "Greetings", "MESSAGE", "message", "Message", "CEO MESSAGE", "Top Message", "Message From The", "企業理念", "経営理念", "学院理念", "理念", "概要", "沿革", "沿 革", "社訓", "社是",
    "理念 沿革", "経営理念 年間スローガン", "経営理念・年間スローガン", "経営理念 方針", "経営理念 行動指針", "企業理念 行動指針", "組織図 役員", "設立趣旨", "役員紹介", "新時代への挑戦",
)
NO_NAME = regex.compile(r"^(?:関係者各位|各位|御中|一同|不明|ふめい|未定|該当なし|お問い合わせ)$")
# words that no name holds
CONTENT = (
    "規約", "ページ", "ダウンロード", "供給", "問い合わせ", "ご相談", "社訓", "行動規範", "行動基準", "SDGs", "講話", "略歴", "安全管理措置", "CORPORATE", "IDENTITY", "company", "Company", "BACK", "Contact",
    "CONTACT", "コープ", "あいさつ", "挨拶", "Greeting", "GREETING", "greeting", "MESSAGE", "Message", "メッセージ", "理念", "企業ビジョン", "社是", "設立趣旨", "退任", "就任", "交代", "所在地", "住所",
    "電話", "TEL", "FAX", "メール", "アドレス", "営業時間", "資本金", "従業員", "社員数", "業種", "業務内容", "社名", "約款", "適用範囲", "管理本部", "監査等", "研修", "認定等", "上場", "創立", "所信",
    "職名", "運営責任者", "NEWS", "Home", "home", "HOME", "ホーム", "TOP", "BLOG", "Blog", "ブログ", "COMPANY", "HISTORY", "OUTLINE", "PRODUCTS", "PRESIDENT", "Time Table", "サイトマップ", "テキスト",
    "フッター", "プロフィール", "経歴", "インタビュー", "コメント", "資格", "質問", "出身地", "実印", "スタッフ一同", "社員一同", "管理者", "価値観", "NPO法人", "医療法人", "社会福祉法人", "土木", "リフォーム",
    "報告", "コミットメント", "構成員", "委員", "コラム", "日記", "概要", "案内", "情報", "紹介", "募集", "方針", "住宅", "新着", "連絡先", "仕事内容", "保証", "購入", "教室", "開発", "販売", "支援", "金融",
    "事業", "店舗", "製品", "商品", "注文", "取引先", "取引銀行", "問題", "品質", "施工", "設計", "製作", "制作", "塗装", "修理", "整備", "工事", "加工", "生産", "計測", "測定", "分析", "診断", "印刷", "設備",
    "機械", "材料", "工具", "不動産", "建設", "建築", "賃貸", "売買", "車検", "車両", "運送", "輸送", "物流", "保育", "介護", "看護", "診療", "医院", "歯科", "薬局", "税理士", "理事長", "取締役", "監査役",
    "役員", "顧問", "氏名", "名前", "確認", "沿革", "設立", "創業", "求人", "採用", "広告", "事例", "実績", "定休日", "受付時間",
)
STOPWORDS = (
    "営業", "採用", "人事", "総務", "経理", "広報", "受付", "窓口", "担当者", "責任者", "事務局", "センター", "グループ", "取締役", "執行役員", "監査役", "理事長", "院長", "支店長", "本部長", "工場長",
    "マネージャー", "manager", "mgr", "ceo", "coo", "cfo", "cto",
)
# endings of firms and of places
TRADES = (
    "紙器|紙工|鋼材|電装|工業|工務|建設|住建|工機|工房|工藝|工芸|製材|製茶|製粉|製菓|製鋼|製作所|製作|機工|機器|器械|設備|電工|電設|電機|電子|通信|運輸|通運|産業|化学|化工|化成|鐵工|鉄工|織機|理化|光学|薬品|"
    "薬局|眼科|歯科|医院|病院|幼稚園|保育所|保育園|信用金庫|銀行|郵便局|研究所|研究機関|大学|短期大|学園|学校|高校|小学校|中学校|生協|協会|神宮|神社|茶屋|温泉|商店|家具|無線|木材|測量|登記|缶詰|道路|海運|"
    "建材|空調|鉄道|製本|看板|解体|葬祭|整体院|料理|酒房|生花|工作所|製麺|総業|乳業|産機"
)
PLACES = (
    "会社|法人|組合|協会|事務局|センター|会館|病院|医院|クリニック|学校|学園|大学|高校|中学|小学校|幼稚園|保育園|施設|寮|館|ホール|ビル|タワー|本社|支社|支店|営業所|工場|研究所|製作所|製麺所|商店|店舗|ホテル|"
    "旅館|神社|寺院|農場|牧場|倉庫|公園|市場|駅|空港|港|団地|マンション|ハイツ|コーポ|号室|事務所|部署|部門|売場|園|店|会"
)
ADDRESS_LIKE = regex.compile("[0-9０-９]|丁目|番地|番|号|都道府県|市.+区|県.+市|市.+町|市.+村|区.+町|区.+村")
FIRM = regex.compile("株式会社|有限会社|合同会社|御中|様")
#: Areas: two of them in a row are no name; those of ``STRICT`` are none alone.
AREAS = frozenset(PREFECTURES) | {
    "北海道", "東北", "関東", "中部", "近畿", "関西", "中国", "四国", "九州", "沖縄", "東海", "札幌", "仙台", "東京", "横浜", "川崎", "相模原", "新潟", "静岡", "浜松", "名古屋", "京都", "大阪", "堺", "神戸", "岡山",
    "広島", "北九州", "福岡", "熊本",
}
STRICT = frozenset(("北海道", "東北", "関東", "中部", "近畿", "関西", "中国", "四国", "九州", "沖縄", "東海", "名古屋", "北名古屋", "北九州", "伊勢志摩", "東近江", "西三河", "東三河"))
# what is cut off before and after a name
LEADS = (r"^職名\s+.+?\s+氏名\s*", r"^職名\s+.+?氏名\s*", r"^氏名\s*", r"^交代\s+", r"^グループCO\s*O\s+")
TAILS = (
    r"\s*(?:殿|印)$", r"\s+様の活動を$", r"\s+様$", r"\s+氏$", r"\s+先生$", r"\s+[^\s]*大学[^\s]*卒$",
    r"(?:トップメッセージ|のメッセージ|からの\s*メッセージ|メッセージ|ごあいさつ|ご挨拶|代表交代のご挨拶|代表挨拶|就任|へ交代|さんの想い|さんが|が出席|のプロフィール|プロフィール|コメント)$",
)

_HAN, _KANA = r"\p{Han}々ヶヵ", r"\p{Hiragana}\p{Katakana}ー"
_JAPANESE = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_STRONG = regex.compile(rf"(?:[{_HAN}]{{1,5}}|\p{{Hiragana}}{{2,8}}|[\p{{Katakana}}ー]{{2,12}}|[A-Za-z]{{2,20}})")
_TOKEN = regex.compile(rf"(?:[{_HAN}{_KANA}]{{1,10}}|[A-Za-z]{{2,20}})")
_LOOSE = regex.compile(rf"(?:[{_HAN}{_KANA}]{{1,12}}|[A-Za-z]{{2,20}})")
_TOWN = regex.compile(r"(?:[\p{Han}\p{Hiragana}\p{Katakana}]{4,}[市区町村]|[\p{Han}\p{Hiragana}\p{Katakana}]{2,}市立[\p{Han}\p{Hiragana}\p{Katakana}]+)")
_FAMILY_CITY = regex.compile(rf"[{_HAN}]{{3,5}}市")
_MARKS = regex.compile("[/／|｜,，、・｡。!！?？:：;；\"'`´]")
_BRACKETS, _INSIDE = regex.compile(r"[【】\[\]「」『』<>〈〉《》〔〕]"), regex.compile("[（(][^）)]*[）)]")
_FOREIGN = regex.compile(r"[\p{Katakana}ー]{2,20}(?:[\s・･]+[\p{Katakana}ー]{2,20})+")
_READING = regex.compile(rf"[{_HAN}][{_HAN}\s]*\s+(?:[A-Za-z]{{2,}}(?:\s+[A-Za-z]{{2,}})+|[\p{{Hiragana}}ー]{{2,}}(?:\s+[\p{{Hiragana}}ー]{{2,}})+)$")
_TWO_NAMES = regex.compile(rf"[{_HAN}]{{1,6}}\s+[{_HAN}]{{1,6}}\s*[・･]\s*[{_HAN}]{{1,6}}\s+[{_HAN}]{{1,6}}")
_FAMILIES = regex.compile(rf"[{_HAN}]{{3,8}}")


def nfkc(s: str) -> str:
    return unicodedata.normalize("NFKC", s)


def spaced(s: str) -> str:
    return " ".join(s.split())


def source(value: str) -> str:
    """Letters and spaces of a value: width folded, bracketed parts out, all else a space."""
    s = _BRACKETS.sub(" ", _INSIDE.sub(" ", nfkc(value)))
    return spaced(regex.sub(r"[^\p{Han}\p{Hiragana}\p{Katakana}A-Za-z\s]", " ", _MARKS.sub(" ", s)))


@dataclass(frozen=True)
class Rules:
    """Word lists, and the tests that they make; ``extra_words`` are (word, kind) with the kinds ``exact`` and ``content``."""

    titles: tuple[str, ...] = TITLES
    after: tuple[str, ...] = AFTER
    not_names: tuple[str, ...] = NOT_NAMES
    content: tuple[str, ...] = CONTENT
    trades: str = TRADES
    places: str = PLACES
    extra_words: tuple[tuple[str, str], ...] = field(default=())

    @cached_property
    def exact(self) -> frozenset[str]:
        """Words that are no name: the plain ones, and greetings with a heading after them."""
        greeted = {f"{g}{mark}{h}" for g in GREETINGS for h in GREETED for mark in " ・"}
        return frozenset(self.not_names) | greeted | {w for w, kind in self.extra_words if kind == "exact"}

    @cached_property
    def _inside(self) -> ahocorasick.Automaton:
        words = ahocorasick.Automaton()
        for w in (*self.content, *(w for w, kind in self.extra_words if kind == "content")):
            words.add_word(w, w)
        words.make_automaton()
        return words

    @cached_property
    def _affixes(self) -> tuple[regex.Pattern, ...]:
        """Titles before a name, titles and forms of address after one, and every title inside a text."""
        titles = "|".join(map(regex.escape, self.titles))
        inside = "|".join(map(regex.escape, (*(t for t in self.titles if t != "代表"), *OFFICERS)))
        return regex.compile(f"^(?:{titles})+"), regex.compile(f"(?:{titles}|{'|'.join(self.after)})+$"), regex.compile(inside)

    @cached_property
    def _trade(self) -> regex.Pattern:
        return regex.compile(f"(?:{self.trades})$")

    @cached_property
    def _place(self) -> regex.Pattern:
        return regex.compile(f"(?:{self.places})$")

    def holds_content(self, s: str) -> bool:
        return next(self._inside.iter(s), None) is not None

    def strip_affixes(self, value: str) -> str:
        """Titles off both ends and forms of address off the end, again and again."""
        before, behind, _ = self._affixes
        s, last = nfkc(value).strip(), None
        while s != last:
            last = s
            s = behind.sub("", before.sub("", s)).strip()
        return s

    def has_title(self, value: str) -> bool:
        return self._affixes[2].search(value) is not None

    def without_titles(self, value: str) -> str:
        return self.strip_affixes(spaced(self._affixes[2].sub(" ", source(value))))

    def forms(self, value: str) -> set[str]:
        """The six forms in which a value is looked up: as it is, width folded, letters alone, marks as spaces, and the last two without titles."""
        marked = spaced(_MARKS.sub(" ", _BRACKETS.sub(" ", _INSIDE.sub(" ", nfkc(value)))))
        letters = source(value)
        return {value.strip(), nfkc(value).strip(), letters, self.strip_affixes(letters), marked, self.strip_affixes(marked)} - {""}

    def is_not_name(self, value: str) -> bool:
        return not self.exact.isdisjoint(self.forms(value))

    def town(self, part: str) -> bool:
        """A municipality, and no family name that ends like one."""
        if not _TOWN.fullmatch(part):
            return False
        s = self.strip_affixes(part)
        return not _FAMILY_CITY.fullmatch(s) or s in STRICT or s in AREAS or bool(self._trade.search(s)) or self.holds_content(s)

    def sound(self, s: str) -> bool:
        """Without digits, firms, addresses."""
        return not (regex.search("[0-9０-９]", s) or FIRM.search(s) or ADDRESS_LIKE.search(s))

    def protected(self, value: str) -> bool:
        """One or two tokens that are surely names."""
        s = self.strip_affixes(value)
        parts = s.split()
        fine = lambda p: _STRONG.fullmatch(p) and nfkc(p) not in STRICT and not self.town(p) and not self._trade.search(p) and not self.holds_content(p)
        return self.sound(s) and 1 <= len(parts) <= 2 and all(map(fine, parts))

    def odd_token(self, value: str) -> bool:
        """A word, place, firm or address; nothing is odd too."""
        s = self.strip_affixes(value)
        if not s or s in self.exact or NO_NAME.match(s) or self._place.search(s):
            return True
        if self.protected(s):
            return False
        low = s.lower()
        stop = any(low.startswith(w) or low.endswith(w) for w in STOPWORDS)
        return stop or nfkc(s) in STRICT or self.town(s) or bool(self._trade.search(s)) or self.holds_content(s) or bool(ADDRESS_LIKE.search(s) or FIRM.search(s))

    def looks_like_name(self, value: str) -> bool:
        s = self.strip_affixes(value)
        if not s or self.protected(s):
            return bool(s)
        parts = s.split()
        if not self.sound(s) or self._trade.search(s) or self.holds_content(s) or not 1 <= len(parts) <= 2:
            return False
        if all(nfkc(p) in STRICT or (len(parts) == 2 and nfkc(p) in AREAS) for p in parts):
            return False
        return all(not self.odd_token(p) and _TOKEN.fullmatch(self.strip_affixes(p)) for p in parts)

    def looks_cleaned(self, value: str) -> bool:
        """The milder test of what is left of a cleaned value: up to four tokens."""
        s = self.strip_affixes(value)
        if not s or self.looks_like_name(s):
            return bool(s)
        parts = s.split()
        if not self.sound(s) or self._trade.search(s) or self.holds_content(s) or not 1 <= len(parts) <= 4:
            return False
        return all(not self.odd_token(p) and _LOOSE.fullmatch(p) for p in parts)

    def token(self, t: str) -> str:
        """A token without Latin letters before Japanese ones, marks, and affixes."""
        s = regex.sub(r"^[A-Za-z]+(?=[\p{Han}\p{Hiragana}\p{Katakana}])", " ", nfkc(t))
        s = spaced(_MARKS.sub(" ", _BRACKETS.sub(" ", s)))
        letter = r"A-Za-z\p{Han}\p{Hiragana}\p{Katakana}"
        return self.strip_affixes(regex.sub(rf"^[^{letter}]+|[^{letter}]+$", "", s).strip())

    def variants(self, t: str) -> list[str]:
        """What a token may stand for: itself, its Japanese runs, Latin letters at its ends; odd ones are none."""
        s = self.token(t)
        runs = regex.findall(rf"[{_JAPANESE}]{{1,12}}", s)
        ends = [m[0] for p in (rf"^[{_JAPANESE}]{{1,12}}", rf"[{_JAPANESE}]{{1,12}}$", "^[A-Za-z]{2,20}", "[A-Za-z]{2,20}$") if (m := regex.search(p, s))]
        return [v for v in dict.fromkeys([s, *ends[:2], *runs, *ends[2:]]) if v and v not in NOISE_TOKENS and not self.odd_token(v)]

    def extracted(self, value: str) -> str | None:
        """The last two tokens that make a name, else the last one that does, else the last run of letters; null if none does."""
        whole = self.without_titles(value)
        tokens = [t for part in whole.split() if (t := self.token(part)) and t not in NOISE_TOKENS]
        read = [self.variants(t) for t in tokens]
        pairs = (f"{a} {b}" for k in range(len(read) - 2, -1, -1) for a in read[k] for b in read[k + 1])
        singles = (v for own in reversed(read) for v in own)
        compact = (self.token(run) for run in reversed(regex.findall(rf"[{_JAPANESE}A-Za-z]{{1,20}}", whole)))
        return next((c for some in (pairs, singles, compact) for c in some if self.looks_like_name(c)), None)

    def cleaned(self, value: str) -> str | None:
        """The name without fixed words before and after it; null if there are none, if a post is named, or if no name is left."""
        original = value.strip()
        s = original
        for p in LEADS:
            s = regex.sub(p, "", s).strip()
        if s == original and self.has_title(original):
            return None
        for p in TAILS:
            s = regex.sub(p, "", s).strip()
        s = spaced(s)
        return s if s not in ("", original) and self.looks_cleaned(s) else None

    def several(self, value: str) -> bool:
        """Two names in one value."""
        parts, pairs, k = source(value).split(), 0, 0
        if len(parts) < 2:
            return False
        if _TWO_NAMES.search(value):
            return True
        while k < len(parts) - 1:
            found = self.looks_cleaned(f"{parts[k]} {parts[k + 1]}")
            pairs, k = pairs + found, k + 1 + found
        return pairs > 1 or (len(parts) == 2 and all(map(_FAMILIES.fullmatch, parts)))

    def keeps(self, value: str) -> str | None:
        """Why a value stays as it is: a name with its post, with its reading, of another country, several names, or a name."""
        if self.has_title(value) and (self.looks_like_name(self.without_titles(value)) or self.extracted(value)):
            return "肩書付きの氏名"
        if _READING.search(source(value)):
            return "読み付きの氏名"
        if _FOREIGN.fullmatch(nfkc(value).strip()):
            return "外国人名"
        if self.several(value):
            return "複数名"
        return "氏名" if self.looks_like_name(value) else None


DEFAULT = Rules()
NOT_A_NAME, CLEANED, EXTRACTED = "氏名ではない文字列", "氏名以外の文字を除去", "氏名を抽出"


def inspect_name(value: str | None, rules: Rules = DEFAULT) -> tuple[str, str | None, str]:
    """(action, name after, reason). A blank is left alone; what is no name goes; what surrounds a name is cut off; names stay.

    What no rule understands is left alone.
    """
    s = (value or "").strip()
    if not s:
        return "none", None, "空欄"
    if rules.is_not_name(s):
        return "delete", None, NOT_A_NAME
    if name := rules.cleaned(s):
        return "update", name, CLEANED
    if why := rules.keeps(s):
        return "none", None, why
    rest = rules.strip_affixes(source(s))
    if not rest or NO_NAME.match(rest):
        return "delete", None, NOT_A_NAME
    if name := rules.extracted(s):
        return ("none", None, "氏名") if spaced(nfkc(s)) == spaced(name) else ("update", name, EXTRACTED)
    return ("delete", None, NOT_A_NAME) if rules.odd_token(rest) else ("none", None, "判定できない")


#: What can be read of a name by itself, and its type.
READINGS = {"exact": ("is_not_name", "boolean"), "stripped": ("strip_affixes", "string"), "cleaned": ("cleaned", "string"), "extracted": ("extracted", "string"), "kept": ("keeps", "string")}


def read_names(df: DataFrame, column: str, readings: tuple[str, ...] = tuple(READINGS), rules: Rules = DEFAULT) -> DataFrame:
    """``df`` with the named ``READINGS`` of a column, null for a null; each distinct name is read once."""
    schema = "v string, " + ", ".join(f"{r} {READINGS[r][1]}" for r in readings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{r: [getattr(rules, READINGS[r][0])(v) for v in batch["v"]] for r in readings})

    found = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().mapInPandas(run, schema)
    return df.join(found, df[column] == found["v"], "left").drop("v")


def inspect_names(df: DataFrame, column: str = "representative_name", key: str = "id", rules: Rules = DEFAULT) -> DataFrame:
    """(row_id, company, before_value, after_value, action, reason) of every row that has a name.

    Each distinct name is looked at once; a name that very many rows have is one row of the helper's input.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [inspect_name(v, rules) for v in batch["v"]]
            yield pd.DataFrame({"v": batch["v"], "action": [o[0] for o in out], "after_value": [o[1] for o in out], "reason": [o[2] for o in out]})

    rows = df.where(not_blank(column)).select(F.col(key).alias("row_id"), "company", F.col(column).alias("before_value"))
    found = rows.select(F.col("before_value").alias("v")).distinct().mapInPandas(run, "v string, action string, after_value string, reason string")
    return rows.join(found, rows["before_value"] == found["v"]).drop("v")


def changes(inspected: DataFrame, remove: bool = True, clean: bool = True) -> DataFrame:
    """Rows with an action, of the kinds that are switched on."""
    kinds = ["delete"] * remove + ["update"] * clean
    return inspected.where(F.col("action").isin(kinds)) if kinds else inspected.limit(0)


def excluded(inspected: DataFrame, changed: DataFrame) -> DataFrame:
    """Inspected rows without a change."""
    out = inspected.join(changed.select("row_id"), "row_id", "left_anti")
    return out.withColumns({"action": F.lit("none"), "reason": F.lit("候補外"), "after_value": F.lit(None).cast("string")})


def summary(inspected: DataFrame, changed: DataFrame) -> DataFrame:
    """Inspected rows, and updates, deletions, reviews and rows left out among them."""
    c = changed.select("row_id", F.col("action").alias("a"))
    rows = inspected.select("row_id").join(c, "row_id", "left")
    n = lambda a: F.count_if(F.col("a") == a)
    return rows.agg(
        F.count("*").alias("total"), n("update").alias("updates"), n("delete").alias("deletes"), n("review").alias("reviews"), F.count_if(F.col("a").isNull()).alias("skipped")
    )
