"""Default lexicons and rule sets.  Every operator takes its lexicon as a parameter; these are the default values.

All tables here are FIXED VALUES: words, weights and patterns that results must agree on, stated as they are.
"""

# fixed values: relevance, phrase -> weight
#: relevance group
RELEVANCE_POLICY = {
    "monetary policy": 6, "fomc": 6, "federal funds rate": 6, "fed funds rate": 6, "policy rate": 5, "rate cut": 5, "rate cuts": 5, "cut rates": 5,
    "cut interest rates": 5, "rate hike": 5, "rate hikes": 5, "raise rates": 5, "raise interest rates": 5, "interest rate": 3, "interest rates": 3,
    "policy stance": 4, "restrictive": 4, "tightening": 4, "easing": 4, "neutral rate": 4, "balance sheet": 4, "quantitative tightening": 5,
    "quantitative easing": 5,
}

#: relevance group
RELEVANCE_MANDATE = {
    "inflation": 3, "price stability": 4, "pce": 3, "core pce": 4, "consumer price": 2, "employment": 3, "labor market": 3, "labour market": 3,
    "unemployment": 3, "payroll": 2, "payrolls": 2, "job market": 2, "jobs": 1, "wage": 2, "wages": 2,
}

#: relevance group
RELEVANCE_MACRO = {
    "economic outlook": 4, "economic activity": 2, "economic growth": 2, "economy": 1, "growth": 1, "gdp": 2, "recession": 3, "consumer spending": 2,
    "consumption": 1, "business investment": 2, "productivity": 1, "tariff": 2, "tariffs": 2, "trade policy": 2, "financial conditions": 3,
    "credit conditions": 2, "financial stability": 2, "supply shock": 2, "supply shocks": 2,
}

#: relevance group
RELEVANCE_LOW = {
    "commencement": -3, "financial inclusion": -2, "community development": -2, "cybersecurity": -2, "responsible innovation": -2,
    "payments conference": -2, "bank supervision": -1, "bank regulation": -1,
}

# fixed values: topics, in order of precedence in the result
#: topic -> keywords
TOPICS = {
    "INFLATION": [
        "inflation", "prices", "price stability", "pce", "cpi", "disinflation",
    ],
    "LABOR": [
        "labor market", "labour market", "employment", "unemployment", "jobs", "wages", "payroll",
    ],
    "RATES": [
        "monetary policy", "interest rate", "interest rates", "federal funds rate", "rate cut", "rate cuts", "rate hike", "rate hikes",
    ],
    "GROWTH": [
        "economic growth", "growth", "gdp", "economy", "economic outlook", "recession",
    ],
    "BALANCE_SHEET": [
        "balance sheet", "reserves", "quantitative tightening", "quantitative easing", "qt", "qe",
    ],
    "FINANCIAL_CONDITIONS": [
        "financial conditions", "credit conditions", "banking system", "liquidity",
    ],
    "TARIFFS": [
        "tariff", "tariffs", "trade policy",
    ],
    "FX": [
        "dollar", "exchange rate", "currency", "foreign exchange",
    ],
}

# fixed values: directional stance
#: terms that make a sentence speak of policy rates
RATE_CONTEXT = [
    "federal funds", "fed funds", "funds rate", "policy rate", "interest rate", "interest rates", "monetary policy", "policy stance",
    "policy restraint", "restrictive policy", "restrictive stance", "easing policy", "policy easing", "policy tightening", "tightening policy",
    "fomc", "federal reserve", "central bank", "rate cut", "rate cuts", "rate hike", "rate hikes", "cut rates", "raise rates", "lower rates",
    "higher rates", "연준", "연방준비제도", "연방공개시장위원회", "기준금리", "정책금리", "통화정책", "정책 기조", "정책기조", "금리 인하", "금리인하", "금리 인상", "금리인상", "금리 동결", "금리동결",
    "금리를 인하", "금리를 인상", "금리를 낮", "금리를 올", "긴축", "완화", "제약적", "중립금리",
]

#: terms of rates that are no policy rates
OTHER_RATES = [
    "delinquent", "delinquency", "default rate", "default rates", "mortality rate", "mortality rates", "participation rate", "participation rates",
    "unemployment rate", "unemployment rates", "vacancy rate", "vacancy rates", "turnover rate", "turnover rates", "response rate", "response rates",
    "adoption rate", "adoption rates", "growth rate", "growth rates", "tax rate", "tax rates", "crime rate", "crime rates", "loan rate",
    "loan rates", "mortgage rate", "mortgage rates", "borrowing rate", "borrowing rates", "failure rate", "failure rates", "recovery rate",
    "recovery rates", "실업률", "참가율", "경제활동참가율", "성장률", "증가율", "감소율", "모기지 금리", "주택담보대출 금리", "대출금리", "연체율", "부도율",
]

#: phrase -> weight
HAWK_PHRASES = {
    "inflation remains elevated": 3, "inflation remains too high": 4, "inflation is too high": 4, "inflation is still too high": 3,
    "inflation has been too high": 4, "inflation above target": 3, "inflation remains above target": 3, "above-target inflation": 3,
    "persistent inflation": 3, "inflationary pressures": 2, "upside risks to inflation": 4, "restrictive policy": 3, "restrictive stance": 3,
    "policy remains restrictive": 3, "appropriately restrictive": 2, "maintain a restrictive stance": 3, "maintain restrictive policy": 3,
    "raise rates": 5, "raise interest rates": 5, "raise the policy rate": 5, "higher policy rate": 4, "rate hike": 4, "rate hikes": 4,
    "further tightening": 4, "additional tightening": 4, "tighten monetary policy": 4, "additional policy restraint": 4, "higher for longer": 4,
    "no rush to cut": 4, "no urgency to cut": 4, "not ready to cut": 4, "not appropriate to cut": 4, "pause in rate cuts": 3, "hold rates steady": 2,
    "economy remains strong": 2, "economy remains resilient": 2, "labor market remains strong": 2, "labor market remains solid": 2,
}

#: phrase -> weight
DOVE_PHRASES = {
    "rate cut": -3, "rate cuts": -3, "cut rates": -4, "cut interest rates": -4, "lower the policy rate": -4, "reduce the policy rate": -4,
    "lower interest rates": -4, "policy easing": -3, "easing of policy": -3, "less restrictive policy": -3, "less restrictive stance": -3,
    "reduce policy restraint": -4, "reduce the degree of policy restraint": -4, "inflation is declining": -2, "inflation has declined": -2,
    "inflation has eased": -2, "price pressures have eased": -2, "inflation moving toward target": -3, "inflation moving towards target": -3,
    "labor market weakening": -4, "labor market has weakened": -4, "labor market has cooled": -3, "labor market is cooling": -3,
    "employment growth has slowed": -3, "job growth has slowed": -3, "unemployment has risen": -3, "downside risks to employment": -4,
    "risks to employment have increased": -4, "economic activity has slowed": -2, "growth has slowed": -2, "downside risks to growth": -3,
}

#: phrase -> weight
HAWK_PHRASES_KO = {
    "금리 인상이 필요": 5, "금리인상이 필요": 5, "금리를 인상해야": 5, "금리를 올려야": 5, "기준금리를 인상": 5, "정책금리를 인상": 5, "추가 금리 인상": 5, "추가적인 금리 인상": 5, "추가 인상": 4,
    "더 높은 금리": 4, "다소 더 높은 금리": 4, "더욱 긴축적인 정책": 6, "더 긴축적인 정책": 6, "긴축적인 정책이 필요": 6, "긴축적 정책이 필요": 6, "긴축적인 통화정책": 5, "긴축적 통화정책": 5, "추가 긴축": 5,
    "추가적인 긴축": 5, "제약적이지 않": 4, "충분히 제약적이지 않": 5, "더 제약적인": 4, "더욱 제약적인": 4, "금리 인하할 이유가 거의 없어": 5, "금리인하할 이유가 거의 없어": 5, "금리 인하할 필요가 없어": 5,
    "금리인하할 필요가 없어": 5, "추가 완화할 이유가 거의 없어": 5, "금리 인하 기회 아냐": 5, "금리인하 기회 아냐": 5, "금리 인하를 서두를": 3, "금리인하를 서두를": 3, "금리 동결을 지지": 2, "금리동결을 지지": 2,
    "동결을 지지": 2, "현 정책기조 적절": 2, "현 정책 기조 적절": 2, "현 금리 수준 적절": 2, "인플레이션이 너무 높": 4, "인플레가 너무 높": 4, "인플레이션은 너무 높": 4, "인플레는 너무 높": 4,
    "인플레이션이 지나치게 높": 4, "인플레가 지나치게 높": 4, "인플레가 너무 뜨겁": 5, "인플레이션이 너무 뜨겁": 5, "인플레이션 압력": 3, "인플레 압력": 3, "인플레이션 상방 위험": 4, "인플레 상방 위험": 4,
    "인플레이션 위험": 2, "인플레 위험": 2, "인플레이션 고착": 5, "인플레 고착": 5, "3%에 더 가깝게 고착": 6, "3% 수준에 더 가깝게 고착": 6, "인플레이션 기대": 2, "기대 인플레이션": 2,
    "인플레이션 측면에서 할 일이": 4, "인플레 측면에서 할 일이": 4, "물가안정을 중시": 3, "물가 안정을 중시": 3, "물가 안정 목표": 2, "경계를 늦출 때 아냐": 4, "경계를 늦출 때 아니다": 4, "경제가 탄탄": 2,
    "경제는 탄탄": 2, "경제가 견조": 2, "경제는 견조": 2, "고용 꽤 좋": 2, "노동시장이 견조": 2, "노동시장은 견조": 2,
}

#: phrase -> weight
DOVE_PHRASES_KO = {
    "금리 인하가 필요": -5, "금리인하가 필요": -5, "금리를 인하해야": -5, "금리를 내려야": -5, "금리 인하를 지지": -5, "금리인하를 지지": -5, "추가 금리 인하": -4, "추가적인 금리 인하": -4,
    "금리 인하 가능": -3, "금리인하 가능": -3, "금리 인하 여력": -4, "금리인하 여력": -4, "몇 차례 금리 인하": -4, "몇차례 금리 인하": -4, "추가 완화가 필요": -4, "완화가 필요": -4, "완화적 정책": -3,
    "완화적인 정책": -3, "제약 수준을 낮": -4, "정책 제약을 줄": -4, "인플레이션이 둔화": -2, "인플레가 둔화": -2, "인플레이션 둔화": -2, "인플레 둔화": -2, "물가 상승률이 둔화": -2, "물가 상승률 둔화": -2,
    "인플레이션이 하락": -2, "인플레가 하락": -2, "인플레이션 정점을 지났": -3, "인플레 정점을 지났": -3, "2% 목표로 복귀": -2, "2%로 복귀": -2, "디스인플레이션": -1, "노동시장 약화": -3,
    "노동시장이 약화": -3, "고용 하방 위험": -4, "고용의 하방 위험": -4, "노동시장 하방 위험": -4, "고용 악화": -3, "실업률 상승": -2, "실업률이 상승": -2, "경기 둔화": -2, "성장 둔화": -2,
    "하방 위험이 커": -3, "금리 인상에 반대": -5, "금리인상에 반대": -5, "금리 인상을 경계": -4, "금리인상을 경계": -4, "금리를 인상할 필요 없어": -5, "금리 인상할 필요 없어": -5, "일시적인 인플레이션": -2,
    "일시적 인플레이션": -2, "일시적인 물가 상승": -2, "일시적 충격으로 간주": -2, "일시적인 충격으로 간주": -2,
}

#: (pattern, weight, signal)
HAWK_CONDITIONS = [
    ("if.{0,100}(inflation|disinflation).{0,80}(does not|doesn't|fails to|do not|not).{0,60}(improve|decline|ease|continue|resume|progress).{0,100}(prepared|ready|willing).{0,40}(act|raise|tighten)", 5, "conditional_tightening"),
    ("if.{0,100}inflation.{0,80}(persist|remain|stay|rise).{0,100}(raise|tighten|increase).{0,40}(rate|rates|policy)", 5, "inflation_persistence_hike"),
    ("cannot rule out.{0,40}(rate hike|rate hikes|raising rates|higher rates)", 4, "cannot_rule_out_hikes"),
    ("(prepared|ready).{0,40}to act.{0,80}inflation", 4, "prepared_to_act_on_inflation"),
]

#: (pattern, weight, signal)
DOVE_CONDITIONS = [
    ("if.{0,100}(employment|labor|labour|growth).{0,70}(weaken|deteriorat|soften|slow).{0,100}(cut|lower|reduce|ease).{0,40}(rate|rates|policy)", -4, "conditional_easing"),
    ("if.{0,100}inflation.{0,70}(decline|ease|improve|progress).{0,100}(cut|lower|reduce).{0,40}(rate|rates|policy)", -3, "inflation_progress_easing"),
]

#: (pattern, weight, signal)
HAWK_PATTERNS = [
    ("inflation.{0,70}(above|over).{0,30}(target|goal|objective)", 3, "inflation_above_target"),
    ("inflation.{0,60}(elevated|too high|persistent)", 3, "inflation_elevated"),
    ("(upside|higher).{0,40}risk.{0,40}inflation", 4, "inflation_upside_risk"),
    ("(more|further|additional).{0,40}progress.{0,40}inflation", 3, "need_more_inflation_progress"),
    ("(remain|keep|maintain).{0,50}restrictive", 3, "maintain_restrictive_policy"),
    ("(no|not).{0,20}(rush|urgency).{0,50}(cut|ease)", 4, "no_rush_to_ease"),
    ("(prepared|ready|willing).{0,30}(to )?(raise|increase).{0,30}(rate|rates|policy rate)", 5, "prepared_to_raise"),
    ("(further|additional).{0,40}(tightening|restraint)", 4, "additional_restraint"),
]

#: (pattern, weight, signal)
DOVE_PATTERNS = [
    ("inflation.{0,60}(moving|returning|converging).{0,40}(toward|towards|closer to).{0,30}(target|goal|objective)", -3, "inflation_moving_to_target"),
    ("(labor|labour).{0,30}market.{0,50}(cool|weaken|soften)", -3, "labor_market_softening"),
    ("(downside|greater).{0,40}risk.{0,50}(employment|labor|labour)", -4, "employment_downside_risk"),
    ("(appropriate|reasonable|warranted).{0,60}(cut|lower|reduce).{0,30}(rate|rates|policy restraint)", -4, "easing_appropriate"),
    ("(reduce|lower).{0,25}(the )?(federal funds|funds|policy).{0,15}rate", -4, "policy_rate_reduction"),
]

#: (pattern, weight, signal)
HAWK_PATTERNS_KO = [
    (r"(추가적인?\s*)?금리\s*인하.{0,80}(인플레|인플레이션|물가).{0,80}(지속|높|위험)", 5, "ko_rate_cut_inflation_risk"),
    ("(인플레|인플레이션|물가).{0,100}(잡|낮추|억제).{0,100}(긴축|제약).{0,50}(필요|요구)", 6, "ko_tightening_required"),
    (r"(현재|현).{0,80}(정책|통화정책).{0,80}(충분히\s*)?제약적이지\s*않", 5, "ko_policy_not_restrictive_enough"),
    (r"(인플레|인플레이션).{0,100}3\s*%.{0,100}(고착|머물|유지)", 6, "ko_inflation_three_percent_risk"),
    (r"(인플레|인플레이션).{0,80}(목표|2\s*%).{0,100}(상회|웃돌).{0,60}(오랫동안|지속)", 4, "ko_inflation_above_target_persistent"),
    ("(금리|기준금리).{0,40}(인상|올려).{0,60}(필요|준비|적절|고려)", 5, "ko_rate_hike"),
    (r"(완전고용|고용).{0,100}(보다|보다는).{0,60}(물가\s*안정|물가안정).{0,60}(중시|우선)", 4, "ko_price_stability_priority"),
    (r"(금리\s*)?동결.{0,50}(지지|적절)", 2, "ko_hold_rates"),
]

#: (pattern, weight, signal)
DOVE_PATTERNS_KO = [
    ("(금리|기준금리).{0,40}(인하|내려).{0,60}(필요|적절|지지|고려)", -5, "ko_rate_cut"),
    (r"(고용|노동시장).{0,100}(약화|둔화|악화|하방).{0,100}(금리\s*)?(인하|완화)", -4, "ko_labor_weakness_easing"),
    (r"(인플레|인플레이션|물가).{0,80}(둔화|하락|개선).{0,100}(금리\s*)?(인하|완화)", -4, "ko_inflation_progress_easing"),
    (r"(금리\s*)?인상.{0,50}(필요\s*없|불필요|반대)", -5, "ko_no_hike_needed"),
    ("(인플레|인플레이션|물가).{0,80}(일시적|단기적).{0,100}(간주|지켜보|넘어가|대응하지)", -3, "ko_look_through_inflation"),
]

#: markers of a stance of the speaker
FIRST_PERSON = [
    "i believe", "i think", "in my view", "i support", "i supported", "i would support", "i favor", "i favour", "i expect", "i see", "i am prepared",
    "i'm prepared", "i am ready", "we should", "we need to", "policy should", "it is appropriate", "would be appropriate", "말했다", "밝혔다", "강조했다",
    "지적했다", "평가했다", "설명했다", "전망했다", "경고했다", "주장했다", "시사했다", "언급했다", "덧붙였다", "필요하다고", "적절하다고", "생각한다고", "본다고", "판단한다고", "지지한다고", "필요하다는", "적절하다는",
    "생각한다", "본다", "판단한다", "지지했다", "반대했다",
]

#: markers of what others think or of the past
REPORTED = [
    "some have argued", "some observers", "some view", "markets expect", "markets were pricing", "market participants expect", "respondents expect",
    "staff projected", "staff forecast", "historically", "in the past", "in 2022", "in 2023", "in 2024", "in 2025", "last year", "previously",
    "시장에서는", "시장 참가자들은", "전문가들은", "이코노미스트들은", "월가에서는", "투자자들은", "시장은 예상", "시장이 예상", "지난해", "작년", "과거에는", "이전에는",
]

#: terms that speak of policy rates whatever else does
STRONG_RATE_CONTEXT = [
    "federal funds", "funds rate", "policy rate", "monetary policy", "fomc", "rate cut", "rate cuts", "rate hike", "rate hikes", "기준금리", "정책금리",
    "통화정책", "연준", "금리 인하", "금리인하", "금리 인상", "금리인상", "금리 동결", "금리동결",
]

#: substrings of phrases that need a policy-rate context
RATE_FAMILY = [
    "rate", "interest", "policy restraint", "금리",
]

# fixed values: news rules, (pattern, weight, reason)
#: rules in order of precedence
NEWS_STRONG_DOVE = [
    (r"\b(warn|warns|warned).{0,25}against.{0,25}(hike|hiking|raise|raising)\b", -5, "warns against hikes"),
    (r"\b(push|pushes|pushed).{0,15}back.{0,15}against.{0,25}(hike|hiking|raise|raising)\b", -5, "pushes back against hikes"),
    (r"\b(reject|rejects|rejected).{0,30}(hike|hiking|higher rate|higher rates)\b", -5, "rejects rate hikes"),
    (r"\bagainst.{0,25}(rate hike|rate hikes|hiking interest rates)\b", -5, "against rate hikes"),
    (r"\b(look through|looks through|looking through).{0,35}(inflation|price|prices|shock|bump)\b", -4, "looks through inflation shock"),
    (r"\b(wary|cautious).{0,30}(reacting|responding).{0,30}(inflation|price|energy)\b", -3, "cautious on inflation response"),
]

#: rules in order of precedence
NEWS_DOVE = [
    (r"\b(support|supports|supported|favor|favors|favours|open to|prepared to|ready to).{0,30}(cut|cuts|cutting|lower|lowering).{0,20}(rate|rates|interest rate|interest rates)\b", -5, "supports cuts"),
    (r"\b(rate cut|rate cuts|lower interest rates)\b", -3, "rate cuts"),
    (r"\binflation.{0,30}(falling|cooling|easing|declining|temporary|transitory)\b", -2, "disinflation"),
    (r"\b(inflation|price pressures).{0,30}(moderating|softening|subsiding)\b", -2, "inflation moderating"),
    (r"\b(labor market|labour market|job market|employment).{0,30}(weak|weakening|slowing|softening|downside)\b", -3, "labor downside"),
    (r"\b(economic growth|economy|growth).{0,30}(weak|weakening|slowing|softening|downside)\b", -2, "growth downside"),
]

#: rules in order of precedence
NEWS_HAWK = [
    (r"\b(support|supports|supported|favor|favors|favours|open to|prepared to|ready to|consider|considers|considering).{0,30}(raise|raising|hike|hiking).{0,20}(rate|rates|interest rate|interest rates)\b", 5, "supports hikes"),
    (r"\b(possible|potential|further|additional).{0,20}(rate hike|rate hikes|tightening)\b", 3, "possible tightening"),
    (r"\b(no rush|not in a hurry|not ready|premature).{0,30}(cut|cuts|cutting|lower|lowering)\b", 5, "resists cuts"),
    (r"\b(hold|holds|holding|keep|keeps|maintain|maintains).{0,20}(rate|rates|policy rate)\b", 2, "hold rates"),
    (r"\binflation.{0,30}(too high|elevated|persistent|sticky|above target)\b", 3, "inflation concern"),
    (r"\b(inflation risk|inflation risks|upside risk to inflation|upside risks to inflation)\b", 3, "inflation upside risks"),
    (r"\b(progress|disinflation).{0,30}(stalled|stalling|stopped)\b", 3, "disinflation stalled"),
    (r"\b(restrictive|restrictive policy).{0,30}(remain|maintain|needed|necessary)\b", 3, "restrictive policy needed"),
]

# fixed values: evidence eligibility
#: policy keywords
EVIDENCE_POLICY = [
    "interest rate", "interest rates", "rate cut", "rate cuts", "rate hike", "rate hikes", "policy rate", "federal funds", "fed funds", "금리", "금리인하",
    "금리 인하", "금리인상", "금리 인상", "기준금리", "monetary policy", "policy stance", "restrictive", "restriction", "tightening", "tighten", "easing", "ease",
    "통화정책", "정책기조", "정책 기조", "긴축", "긴축적", "완화", "완화적", "제약적", "inflation", "price stability", "price pressures", "inflation expectations",
    "2 percent", "2% target", "인플레이션", "물가", "물가안정", "물가 안정", "물가압력", "물가 압력", "기대인플레이션", "기대 인플레이션", "labor market", "labour market", "employment",
    "unemployment", "job market", "노동시장", "노동 시장", "고용", "실업", "fomc", "federal open market committee", "open market committee", "연방공개시장위원회",
    "balance sheet", "quantitative tightening", "quantitative easing", "qt", "qe", "대차대조표", "양적긴축", "양적완화", "neutral rate", "neutral interest rate",
    "r-star", "r star", "중립금리", "중립 금리",
]

#: signs of direct speech
EVIDENCE_SPEECH = [
    "말했다", "밝혔다", "강조했다", "언급했다", "설명했다", "평가했다", "진단했다", "경계했다", "지적했다", "주장했다", "전망했다", "시사했다", "덧붙였다", "전했다", "견해를 밝혔다", "입장을 밝혔다", "생각한다", "본다",
    "판단한다", "연설에서", "준비한 연설", "준비된 연설", "경제 포럼에서", "경제포럼에서", "인터뷰에서", "기자들에게", "기자회견에서", "토론에서", "패널에서", " said ", " says ", " stated ", " noted ",
    " told ", " remarked ", " argued ", " emphasized ", " stressed ", " warned ", " believes ", " thinks ", " speaking at ", " in a speech ",
    " in prepared remarks ", " in an interview ",
]

# fixed values: fingerprints, label -> phrases
#: label -> phrases
FINGERPRINTS = {
    "RATE_HIKE": [
        "rate hike", "rate hikes", "raise rates", "raise interest rates", "higher rates", "higher interest rates", "금리 인상", "금리인상", "금리를 인상",
        "금리를 올려", "더 높은 금리",
    ],
    "RATE_CUT": [
        "rate cut", "rate cuts", "cut rates", "lower rates", "lower interest rates", "금리 인하", "금리인하", "금리를 인하", "금리를 내려",
    ],
    "HOLD": [
        "hold rates", "hold rates steady", "keep rates unchanged", "rates unchanged", "금리 동결", "금리동결", "동결을 지지", "현 금리 수준",
    ],
    "TIGHTENING": [
        "tightening", "further tightening", "additional tightening", "restrictive policy", "restrictive stance", "more restrictive",
        "tighter monetary policy", "긴축", "긴축적", "긴축적인", "제약적", "더 제약적인", "더욱 긴축적인 정책",
    ],
    "EASING": [
        "easing", "policy easing", "less restrictive", "accommodative", "완화", "완화적", "정책 완화",
    ],
    "INFLATION_HIGH": [
        "inflation too high", "inflation remains too high", "inflation is too high", "inflation remains elevated", "persistent inflation",
        "인플레이션이 너무 높", "인플레가 너무 높", "인플레이션이 지나치게 높", "인플레가 지나치게 높", "인플레이션이 너무 뜨겁", "인플레가 너무 뜨겁",
    ],
    "INFLATION_RISK": [
        "inflation risk", "inflation risks", "upside risks to inflation", "inflationary pressures", "inflation pressure", "inflation expectations",
        "persistent inflation", "인플레이션 위험", "인플레 위험", "인플레이션 압력", "인플레 압력", "인플레이션 상방 위험", "인플레 상방 위험", "인플레이션 고착", "인플레 고착", "기대 인플레이션",
    ],
    "INFLATION_IMPROVING": [
        "disinflation", "inflation is declining", "inflation has declined", "inflation has eased", "inflation moving toward target",
        "inflation moving towards target", "인플레이션 둔화", "인플레 둔화", "인플레이션 하락", "인플레 하락", "2% 목표로 복귀", "2%로 복귀", "디스인플레이션",
    ],
    "LABOR_STRONG": [
        "labor market remains strong", "labor market remains solid", "labor market resilient", "employment remains strong", "고용 꽤 좋", "고용 견조",
        "노동시장 견조", "노동시장이 견조",
    ],
    "LABOR_WEAK": [
        "labor market weakening", "labor market has weakened", "labor market is cooling", "labor market has cooled", "downside risks to employment",
        "고용 하방 위험", "노동시장 하방 위험", "고용 악화", "노동시장 약화",
    ],
    "GROWTH_STRONG": [
        "economy remains strong", "economy remains resilient", "strong demand", "economic activity remains strong", "경제가 탄탄", "경제는 탄탄", "경제가 견조",
        "경제는 견조", "수요가 강",
    ],
    "GROWTH_WEAK": [
        "growth has slowed", "economic activity has slowed", "downside risks to growth", "growth weakening", "경기 둔화", "성장 둔화", "성장 약화",
    ],
    "BALANCE_SHEET": [
        "balance sheet", "reserves", "reserve balances", "대차대조표", "준비금", "지준",
    ],
}

#: source type -> priority when events are merged
SOURCE_PRIORITY = {
    "OFFICIAL": 100, "FED_BOARD": 100, "REGIONAL_FED": 100, "INFOMAX": 80, "NEWS": 50,
}

# fixed values: news filters
#: terms of relevant news
NEWS_POLICY = [
    "rate", "rates", "interest rate", "interest rates", "inflation", "monetary policy", "policy stance", "tightening", "easing", "hike", "hiking",
    "cut", "cuts", "cutting", "hold", "restrictive", "employment", "labor market", "labour market", "price stability", "2%",
]

#: terms of irrelevant news
NEWS_VETO = [
    "private dinner", "bank of america dinner", "quiet period", "watchdog", "ethics", "investigate", "senate scrutiny", "spending practices",
    "wall street bankers",
]

#: outlets of more weight
PREFERRED_OUTLETS = [
    "AP News", "American Banker", "Associated Press", "Barron's", "Bloomberg", "Bloomberg.com", "CNBC", "Financial Times", "MarketWatch", "Reuters",
    "The Wall Street Journal", "The Washington Post", "WSJ",
]

#: title terms of round-ups and third-party views
WIRE_TITLE_VETO = [
    "뉴욕 마켓 브리핑", "뉴욕마켓워치", "뉴욕채권", "뉴욕환시", "뉴욕 금가격", "채권-주간", "증시-주간전망", "주간전망", "오늘 글로벌 경제지표", "딜링룸 24시", "전문] 연준", "[전문]", "전문가 시각", "월가의", "월가 ",
    "해외ib", "bofa ", "ing ", "맥쿼리 ", "골드만", "jp모건", "씨티 ", "크루그먼", "뷰포인트", "icyMI", "icymi",
]

#: speech verbs
WIRE_SPEECH_VERBS = [
    "말했다", "밝혔다", "강조했다", "지적했다", "평가했다", "설명했다", "전망했다", "언급했다", "주장했다", "경고했다", "시사했다", "덧붙였다", "선호한다", "선호한다고", "생각한다", "생각한다고", "본다", "본다고",
    "판단한다", "판단한다고", "필요하다", "필요하다고", "적절하다", "적절하다고", "준비돼", "준비되어", "지지했다", "지지한다", "반대했다", "반대한다",
]

#: policy terms
WIRE_POLICY = [
    "금리", "기준금리", "금리인하", "금리 인하", "금리인상", "금리 인상", "동결", "인플레이션", "인플레", "물가", "연준", "fomc", "통화정책", "긴축", "완화", "제약적", "중립금리", "노동시장", "고용", "실업률",
    "interest rate", "rate cut", "rate hike", "inflation", "monetary policy",
]

#: quotation marks
QUOTES = [
    "\"", "'", "“", "”", "‘", "’",
]

# fixed values: export
#: columns in order
EXPORT_COLUMNS = [
    "published_at", "member_name_ko", "member_name_en", "member_role_ko", "member_role_en", "member_fed", "member_voter", "member_vote_year",
    "member_priority", "title", "url", "source", "speaker_raw", "fomc_relevance", "relevance_score", "topics", "hawk_dove_label", "hawk_dove_score",
    "speech_current_label", "speech_current_score", "speech_sample_count", "momentum_label", "momentum_score", "momentum_confidence",
    "momentum_recent_avg", "momentum_previous_avg", "momentum_recent_count", "momentum_previous_count", "momentum_total_important_count",
    "news_label", "news_score", "news_confidence", "news_article_count", "news_usable_count", "news_cluster_count", "consensus_label",
    "consensus_score", "cross_check", "body_fetched", "text",
]

#: display names of exported columns
EXPORT_NAMES = {
    "published_at": "Date", "member_name_ko": "Member_KO", "member_name_en": "Member_EN", "member_role_ko": "Role_KO", "member_role_en": "Role_EN",
    "member_fed": "Fed", "member_voter": "Voter", "member_vote_year": "Term", "member_priority": "Priority", "title": "Title", "url": "URL",
    "source": "Source", "speaker_raw": "Speaker_Raw", "fomc_relevance": "FOMC_Relevance", "relevance_score": "Relevance_Score", "topics": "Topics",
    "hawk_dove_label": "Hawk_Dove", "hawk_dove_score": "Hawk_Dove_Score", "speech_current_label": "Current_Stance",
    "speech_current_score": "Current_Stance_Score", "speech_sample_count": "Current_Stance_Samples", "momentum_label": "Momentum",
    "momentum_score": "Momentum_Score", "momentum_confidence": "Momentum_Confidence", "momentum_recent_avg": "Momentum_Recent_Avg",
    "momentum_previous_avg": "Momentum_Previous_Avg", "momentum_recent_count": "Momentum_Recent_N", "momentum_previous_count": "Momentum_Previous_N",
    "momentum_total_important_count": "Momentum_Important_N", "news_label": "News_Stance", "news_score": "News_Score",
    "news_confidence": "News_Confidence", "news_article_count": "News_Articles", "news_usable_count": "News_Usable",
    "news_cluster_count": "News_Clusters", "consensus_label": "Consensus", "consensus_score": "Consensus_Score", "cross_check": "Cross_Check",
    "body_fetched": "Body_Fetched", "text": "Text",
}
