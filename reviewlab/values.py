"""Literals that results depend on, stated as they are."""

# Mask tokens.
STORE = "#@상호명#"
PLACE = "#@위치#"
ORGANISATION = "#@기관#"
CUSTOMER = "#@고객이름#"
CONTACT = "#@전화번호#"
MASK_TOKENS = [STORE, PLACE, ORGANISATION, CUSTOMER, CONTACT]

# Placeholders used in review tables.
NO_RATING = "별점X"
NO_MENU = "메뉴X"
GUEST_ID = "   손님"
FAILED_REPLY = "오류 발생"
REPLY_PREFIX = "사장답글:"
DROPPED_LITERAL = "#식후감"

# Model text markers.
REPLY_MARK = "<unused1>"
END_MARK = "<eos>"

# Character classes. \s and \w are ASCII-only in Java, so the Unicode members
# are spelt out; both strings go inside [...].
SPACE = r"\t\n\x0b\f\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"

# Label threshold, similarity gates and length limits.
LABEL_THRESHOLD = 0.4
SIMILARITY_GATE = 0.4
REVIEW_LIMITS = (15, 100)
REPLY_LIMITS = (50, 200)

# Literals counted by the text profile.
PROFILE_LITERALS = ["고객님", "사진", "@", "ㅎ", "ㅠ", "ㅜ", "ㅋ", "손님"]
# Characters that the profile does not report.
PROFILE_ALLOWED = "a-zA-Z0-9가-힣.,<>/?!@~*^ㅠㅜㅎ "
# Characters kept by text normalisation before overlap metrics.
NORMAL_CLASS = "A-Za-z0-9가-힣"

# Store names masked by the second masking pass, first match wins.
STORE_TERMS = [
    "빠바", "파바", "파리바게트", "투썸", "이디야", "테그 42", "메가커피", "망티",
    "스페이스핫도그", "그리너", "크로플덕", "요아정", "크로플각", "엉클도넛", "호구호구",
    "그린프루츠", "헤브번", "영스타", "딜리버거 & 카페", "가베 95카페", "샐러드 스탑",
    "퍼스트에이드", "날쌘카페", "사이드테이블", "아요성", "sky31", "반달", "퀸즈", "1L카페",
    "카페 쉼", "온리 요거트", "밝을현", "행복한 날에", "노꼬", "배스킨",
    "아리스타샌드위치", "컴포즈", "엔젤", "커피사피엔스", "커피101", "펠롱크라상", "십일리터",
    "파리바게트", "앤제리너스", "영영상점", "파바", "달달상큼", "빽다방", "뜌레쥬르", "SKY31",
    "베라", "던킨", "설빙", "파리바게뜨", "투썸", "요거프레소", "BROWN", "커피사피엔스",
    "메가커피", "에그드랍", "해피엔파크", "커피야", "이디야", "크리스피크림", "공차",
    "파리바게뜨", "앤젤", "24H", "뚜레쥬르", "커피101", "파빠", "샵 일리터", "이삭",
    "토프레소", "이삭토스트", "뚜주", "쥬씨", "롯데마트", "사피엔스", "샐러디",
]

# Place names masked by the second masking pass, first match wins.
PLACE_TERMS = [
    "구로태평양IT점", "문래 6가점", "c구로점", "신도림", "LG 트윈타워점", "청 량 리역사점",
    "PB한양대병원", "구로로제리움",
    "공덕점", "미사점", "마곡나루역점", "노원점", "강*구", "이촌점", "리앤파크점",
    "신림 양지병원점", "동대문점", "왕십리역사점", "양재본점",
    "가재울점", "연신내점", "문화의거리점", "이대점", "영등포점", "보스턴 대학 법학관점",
    "합정점", "구디점", "북부점", "개봉중앙점", "하계벽산점", "강남구청점",
    "잠실점", "신이문점", "구로점", "응암역점", "화곡역점", "시장역점", "이대역점", "신촌점",
    "고대점", "행당점", "구로디저턱열점", "회기역점", "회기역사점", "하계벽산점", "면목역점",
    "신이문역점", "신이문점",
    "라온유아파트", "홍제점", "홍대입구점", "신논현점", "행당역점", "문정점", "오목교점",
    "청담점", "마곡나루점", "미아현대점", "서초점", "해링턴점", "송파점", "발산역점",
    "길동사거리점", "이아삼거리점", "이지점", "강남역", "안암역점", "합정점", "이문역",
    "서울대점", "개봉중앙점",
    "군자점", "신림양지점", "응암점", "압구정점", "구로점", "문정까페점", "역삼점",
    "미아삼거리", "시립대점", "대방역점", "영등포", "신길점", "신방화점", "양재본점",
    "홍은벽산점", "홍제점", "이촌시내점", "노원점", "대방역점", "합정역사거리점", "용마산점",
    "석촌점", "충앙점", "온수점", "방학사거리", "수유역점", "강남본점", "석촌점",
    "매움점", "구로점", "옥길점", "은평구산점", "공릉점", "서오릉점", "센트라스점", "수유점",
    "상봉점", "회기역점", "와이어스퀘어", "사당점", "종암사거리", "신방화점", "상계본점",
    "상계문화교", "가재울점", "고덕리엔파크점", "애오개점", "행당점", "신장사거리",
    "엔젤영점", "이문점", "마곡나루점", "신당중앙점", "문정점", "신월현대점", "아차산점",
    "길동사거리점",
]

# Organisations and customer names masked by the second masking pass.
ORGANISATION_TERMS = [
    "요기요", "배달의민족", "BR딜리버리", "도봉구 복지재단", "요기요익스프레스", "배민",
]
CUSTOMER_TERMS = ["하늘을달리다"]
