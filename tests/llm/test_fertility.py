from __future__ import annotations

import base64

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from chargeframe.llm import fertility
from chargeframe.llm.wordbpe import encoder

RUSSIAN = ("Вчера вечером мы долго гуляли по старому городу и разговаривали о книгах, которые прочитали за лето. Погода была "
           "тёплая, на улицах играла музыка, а в маленьких кафе сидели люди и пили чай. Мой брат рассказал, что скоро поедет учиться.")
CHINESE = "今天早上我去市场买菜,看见很多人在排队。天气很好,孩子们在公园里玩耍。老师说下个星期我们要去博物馆参观,大家都非常高兴。这本书讲的是一个年轻人离开家乡的故事。"
VIETNAMESE = ("Tối hôm qua chúng tôi đi dạo trong thành phố cổ và nói chuyện về những cuốn sách đã đọc vào mùa hè. Thời tiết ấm áp và "
              "trên đường phố có tiếng nhạc. Anh trai tôi kể rằng sắp tới anh sẽ đi học ở một đất nước khác.")
GREEK = ("Χθες το βράδυ περπατήσαμε στην παλιά πόλη και μιλήσαμε για τα βιβλία που διαβάσαμε το καλοκαίρι. Ο καιρός ήταν ζεστός και "
         "στους δρόμους ακουγόταν μουσική.")
GEORGIAN = "გუშინ საღამოს ძველ ქალაქში ვისეირნეთ და ზაფხულში წაკითხულ წიგნებზე ვისაუბრეთ. ამინდი თბილი იყო და ქუჩებში მუსიკა ისმოდა."
AMHARIC = "ትናንት ማታ በአሮጌው ከተማ ተዘዋውረን በበጋ ስላነበብናቸው መጻሕፍት ተነጋገርን። አየሩ ሞቃት ነበር በመንገዶችም ሙዚቃ ይሰማ ነበር።"
rng = np.random.default_rng(5)


def _noise(first, last, n=12):
    return " ".join("".join(chr(int(c)) for c in rng.integers(first, last, n)) for _ in range(60))


def _lines(text, n):
    return "\n".join(text[i:i + n] for i in range(0, len(text), n))


BROKEN = {
    "hex": _lines(rng.bytes(1920).hex(), 64), "base64": _lines(base64.b64encode(rng.bytes(3000)).decode(), 76), "numbers": " ".join(map(str, rng.integers(0, 10**9, 150))),
    "cjk": _noise(0x4E00, 0x9FFF), "hangul": _noise(0xAC00, 0xD7A3), "private use": _noise(0xE000, 0xE0FF), "braille": _noise(0x2800, 0x28FF),
    "cp1251": RUSSIAN.encode().decode("cp1251", "replace"), "latin1": RUSSIAN.encode().decode("latin1"),
    "cp1252": CHINESE.encode().decode("cp1252", "replace"), "bytes": rng.bytes(3000).decode("utf8", "replace"),
}


def _in_band(text):
    return fertility.in_band(fertility.BANDS[fertility.script(text)], *fertility._meter(None).measure(text, len("".join(text.split()))))


@pytest.mark.parametrize("name", BROKEN)
def test_noise_and_encoded_data_are_rejected(name):
    assert not _in_band(BROKEN[name])


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE, VIETNAMESE, GREEK, GEORGIAN, AMHARIC])
def test_clean_prose_of_other_scripts_is_kept(text):
    assert _in_band(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", " ", "\n", "\x7f", "é", "日", "😀", "<|endoftext|>", "\x00", "\xa0", "'s", "1!"])).map("".join))
@example("")
def test_word_counts_are_those_of_the_ids(text):
    assert encoder().count(text) == len(encoder().encode(text)) // 4
