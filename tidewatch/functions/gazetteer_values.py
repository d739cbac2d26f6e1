"""Place dictionary used by the text geocoder.

Fixed values: names, coordinates and codes must match published event
locations exactly, so they are stated literally, one place per line, as
``name, latitude, longitude, code``.  Callers can pass their own tables to
:class:`tidewatch.functions.places_text.Gazetteer`.
"""

CITIES = """
new york, 40.7128, -74.0060, US
san francisco, 37.7749, -122.4194, US
los angeles, 34.0522, -118.2437, US
seattle, 47.6062, -122.3321, US
boston, 42.3601, -71.0589, US
chicago, 41.8781, -87.6298, US
atlanta, 33.7490, -84.3880, US
london, 51.5074, -0.1278, GB
brussels, 50.8503, 4.3517, BE
paris, 48.8566, 2.3522, FR
berlin, 52.5200, 13.4050, DE
frankfurt, 50.1109, 8.6821, DE
munich, 48.1351, 11.5820, DE
moscow, 55.7558, 37.6173, RU
kyiv, 50.4501, 30.5234, UA
kiev, 50.4501, 30.5234, UA
beijing, 39.9042, 116.4074, CN
shanghai, 31.2304, 121.4737, CN
hong kong, 22.3193, 114.1694, HK
taipei, 25.0330, 121.5654, TW
tokyo, 35.6762, 139.6503, JP
seoul, 37.5665, 126.9780, KR
singapore, 1.3521, 103.8198, SG
new delhi, 28.6139, 77.2090, IN
delhi, 28.6139, 77.2090, IN
mumbai, 19.0760, 72.8777, IN
dubai, 25.2048, 55.2708, AE
riyadh, 24.7136, 46.6753, SA
tel aviv, 32.0853, 34.7818, IL
jerusalem, 31.7683, 35.2137, IL
tehran, 35.6892, 51.3890, IR
baghdad, 33.3152, 44.3661, IQ
kabul, 34.5553, 69.2075, AF
islamabad, 33.6844, 73.0479, PK
lagos, 6.5244, 3.3792, NG
johannesburg, -26.2041, 28.0473, ZA
cairo, 30.0444, 31.2357, EG
nairobi, -1.2921, 36.8219, KE
jakarta, -6.2088, 106.8456, ID
manila, 14.5995, 120.9842, PH
sydney, -33.8688, 151.2093, AU
ottawa, 45.4215, -75.6972, CA
toronto, 43.6532, -79.3832, CA
mexico city, 19.4326, -99.1332, MX
buenos aires, -34.6037, -58.3816, AR
sao paulo, -23.5505, -46.6333, BR
rio de janeiro, -22.9068, -43.1729, BR
the hague, 52.0705, 4.3007, NL
amsterdam, 52.3676, 4.9041, NL
rotterdam, 51.9244, 4.4777, NL
stockholm, 59.3293, 18.0686, SE
oslo, 59.9139, 10.7522, NO
helsinki, 60.1699, 24.9384, FI
warsaw, 52.2297, 21.0122, PL
prague, 50.0755, 14.4378, CZ
vienna, 48.2082, 16.3738, AT
zurich, 47.3769, 8.5417, CH
geneva, 46.2044, 6.1432, CH
rome, 41.9028, 12.4964, IT
madrid, 40.4168, -3.7038, ES
lisbon, 38.7223, -9.1393, PT
athens, 37.9838, 23.7275, GR
ankara, 39.9334, 32.8597, TR
istanbul, 41.0082, 28.9784, TR
gaza, 31.3547, 34.3088, PS
rafah, 31.2825, 34.2447, PS
khartoum, 15.5007, 32.5599, SD
addis ababa, 9.0320, 38.7470, ET
kinshasa, -4.4419, 15.2663, CD
cape town, -33.9249, 18.4241, ZA
kigali, -1.9706, 30.1044, RW
dakar, 14.7167, -17.4677, SN
accra, 5.6037, -0.1870, GH
casablanca, 33.5731, -7.5898, MA
tunis, 36.8065, 10.1815, TN
algiers, 36.7538, 3.0588, DZ
tripoli, 32.8872, 13.1913, LY
caracas, 10.4806, -66.9036, VE
havana, 23.1136, -82.3666, CU
sanaa, 15.3694, 44.1910, YE
damascus, 33.5138, 36.2765, SY
beirut, 33.8938, 35.5018, LB
amman, 31.9454, 35.9284, JO
hebron, 31.5326, 35.0998, PS
nablus, 32.2211, 35.2544, PS
jenin, 32.4573, 35.2287, PS
ramallah, 31.9038, 35.2034, PS
bethlehem, 31.7054, 35.2024, PS
jericho, 31.8667, 35.4500, PS
tulkarm, 32.3104, 35.0286, PS
qalqilya, 32.1897, 34.9706, PS
salfit, 32.0836, 35.1749, PS
tubas, 32.3211, 35.3697, PS
doha, 25.2854, 51.5310, QA
muscat, 23.5880, 58.3829, OM
kuwait city, 29.3759, 47.9774, KW
phnom penh, 11.5564, 104.9282, KH
ho chi minh, 10.8231, 106.6297, VN
vietnam city, 10.8231, 106.6297, VN
hanoi, 21.0285, 105.8542, VN
vientiane, 17.9757, 102.6033, LA
yangon, 16.7867, 96.1641, MM
kuala lumpur, 3.1390, 101.6869, MY
vilnius, 54.6872, 25.2797, LT
riga, 56.9496, 24.1052, LV
tallinn, 59.4370, 24.7536, EE
belgrade, 44.7866, 20.4489, RS
zagreb, 45.8150, 15.9819, HR
sofia, 42.6977, 23.3219, BG
bucharest, 44.4268, 26.1025, RO
tirana, 41.3275, 19.8187, AL
podgorica, 42.4304, 19.2599, ME
skopje, 41.9979, 21.4286, MK
ljubljana, 46.0569, 14.5058, SI
bratislava, 48.1486, 17.1077, SK
luxembourg city, 49.6113, 6.1322, LU
dublin, 53.3498, -6.2603, IE
reykjavik, 64.1466, -21.9426, IS
tbilisi, 41.7151, 44.8271, GE
yerevan, 40.1792, 44.4993, AM
baku, 40.4095, 49.8671, AZ
astana, 51.1604, 71.4752, KZ
almaty, 43.2220, 76.8512, KZ
dushanbe, 38.5598, 68.7870, TJ
ashgabat, 37.9514, 58.3242, TM
minsk, 53.9006, 27.5590, BY
"""

REGIONS = """
west bank, 31.9466, 35.3027, PS, West Bank, Palestine
hormuz, 26.5667, 56.2528, INT, Strait of Hormuz, INT
panama canal, 9.08, -79.68, PA, Panama Canal, PA
red sea, 19.5000, 38.7000, INT, Red Sea, open water (INT)
gulf of aden, 12.6667, 48.6667, INT, Gulf of Aden, open water (INT)
"""

COUNTRIES = """
united states, 39.8283, -98.5795, US
US, 39.8283, -98.5795, US
U.S., 39.8283, -98.5795, US
U.S, 39.8283, -98.5795, US
united kingdom, 55.3781, -3.4360, GB
britain, 55.3781, -3.4360, GB
russia, 61.5240, 105.3188, RU
ukraine, 48.3794, 31.1656, UA
china, 35.8617, 104.1954, CN
japan, 36.2048, 138.2529, JP
south korea, 35.9078, 127.7669, KR
north korea, 40.3399, 127.5101, KP
taiwan, 23.6978, 120.9605, TW
iran, 32.4279, 53.6880, IR
iraq, 33.2232, 43.6793, IQ
israel, 31.0461, 34.8516, IL
palestine, 31.9522, 35.2332, PS
syria, 34.8021, 38.9968, SY
lebanon, 33.8547, 35.8623, LB
yemen, 15.5527, 48.5164, YE
saudi arabia, 23.8859, 45.0792, SA
türkiye, 38.9637, 35.2433, TR
egypt, 26.8206, 30.8025, EG
sudan, 12.8628, 30.2176, SD
ethiopia, 9.1450, 40.4897, ET
kenya, -0.0236, 37.9062, KE
nigeria, 9.0820, 8.6753, NG
south africa, -30.5595, 22.9375, ZA
indonesia, -0.7893, 113.9213, ID
philippines, 12.8797, 121.7740, PH
australia, -25.2744, 133.7751, AU
canada, 56.1304, -106.3468, CA
mexico, 23.6345, -102.5528, MX
brazil, -14.2350, -51.9253, BR
argentina, -38.4161, -63.6167, AR
colombia, 4.5709, -74.2973, CO
venezuela, 6.4238, -66.5897, VE
germany, 51.1657, 10.4515, DE
france, 46.2276, 2.2137, FR
spain, 40.4637, -3.7492, ES
italy, 41.8719, 12.5674, IT
netherlands, 52.1326, 5.2913, NL
belgium, 50.5039, 4.4699, BE
switzerland, 46.8182, 8.2275, CH
austria, 47.5162, 14.5501, AT
poland, 51.9194, 19.1451, PL
sweden, 60.1282, 18.6435, SE
norway, 60.4720, 8.4689, NO
finland, 61.9241, 25.7482, FI
denmark, 56.2639, 9.5018, DK
greece, 39.0742, 21.8243, GR
portugal, 39.3999, -8.2245, PT
romania, 45.9432, 24.9668, RO
hungary, 47.1625, 19.5033, HU
afghanistan, 33.9391, 67.7100, AF
pakistan, 30.3753, 69.3451, PK
india, 20.5937, 78.9629, IN
bangladesh, 23.6850, 90.3563, BD
thailand, 13.7563, 100.5018, TH
vietnam, 16.5000, 107.8000, VN
myanmar, 21.9000, 95.9643, MM
burma, 21.9000, 95.9643, MM
malaysia, 4.2100, 101.9758, MY
cambodia, 12.5700, 104.9900, KH
laos, 19.2500, 102.4700, LA
bahrain, 26.0700, 50.5500, BH
qatar, 25.3500, 51.1832, QA
oman, 21.4700, 55.9800, OM
kuwait, 29.3100, 47.4807, KW
jordan, 30.5900, 36.2400, JO
belarus, 53.7100, 27.9300, BY
czechia, 49.8200, 15.4699, CZ
libya, 26.3400, 17.2300, LY
morocco, 31.7900, -7.0900, MA
algeria, 28.0400, 1.6600, DZ
tunisia, 33.8800, 9.5000, TN
mali, 17.5700, -3.9900, ML
chad, 15.4500, 18.7300, TD
angola, -11.2000, 17.8700, AO
peru, -9.1900, -75.0200, PE
ecuador, -1.8300, -78.1800, EC
turkey, 38.9637, 35.2433, TR
"""

# Names matched with their exact spelling; every other name ignores case.
CASE_SENSITIVE = ("US", "U.S.", "U.S")
