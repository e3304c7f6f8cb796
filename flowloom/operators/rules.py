"""Rule tables over group profiles, behaviour and tactic distributions, benign groups, default labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---- fixed values -----------------------------------------------------------------------------------------------------

#: (profile, feature, op, low, high, weight); ``>`` and ``<`` are strict and use ``low``, ``in`` includes both ends.
BOT_IOT_RULES = [
    ("syn_flooding", "min_ttl", ">", 36.8, None, 1.0495),
    ("syn_flooding", "iat_max", ">", 2925.0, None, 0.8099),
    ("syn_flooding", "tcp_flags", "<", 9.6, None, 0.7627),
    ("syn_flooding", "iat_avg", ">", 1186.0, None, 0.7507),
    ("syn_flooding", "tcp_win_in", "<", 881.0, None, 0.6978),
    ("syn_flooding", "pps", "<", 2553.0, None, 0.3991),
    ("syn_flooding", "duration", ">", 12714.0, None, 0.2864),
    ("syn_flooding", "iat_std", ">", 667.0, None, 0.2360),
    ("port_scanning", "min_ttl", "<", 9.1, None, 1.0495),
    ("port_scanning", "iat_max", "<", 61.0, None, 0.8099),
    ("port_scanning", "iat_avg", "<", 22.0, None, 0.7507),
    ("port_scanning", "dst_port", ">", 11432.0, None, 0.4354),
    ("port_scanning", "duration", "<", 308.0, None, 0.2864),
    ("port_scanning", "iat_std", "<", 13.0, None, 0.2360),
    ("data_transfer", "tcp_win_in", ">", 11475.0, None, 0.6978),
    ("data_transfer", "fan_out", ">", 30.5, None, 0.6119),
    ("data_transfer", "out_bytes", ">", 100000.0, None, 0.2),
    ("data_transfer", "dir_ratio", ">", 3.0, None, 0.2),
    ("normal_activity", "min_ttl", "in", 9.1, 36.8, 1.0495),
    ("normal_activity", "iat_max", "in", 61.0, 2925.0, 0.8099),
    ("normal_activity", "tcp_flags", ">", 9.6, None, 0.7627),
    ("normal_activity", "iat_avg", "in", 22.0, 1186.0, 0.7507),
    ("normal_activity", "tcp_win_in", "in", 881.0, 11475.0, 0.6978),
    ("normal_activity", "fan_out", "<", 30.5, None, 0.6119),
    ("normal_activity", "duration", "in", 308.0, 12714.0, 0.2864),
]

#: The same for UNSW-NB15; ``behaviour#attack`` profiles share a behaviour.
UNSW_RULES = [
    ("service_probing", "tcp_flags", ">", 23.65, None, 0.1568),
    ("service_probing", "longest_pkt", "in", 392.5, 480.4, 0.1154),
    ("service_probing", "dst_port", "<", 265.7, None, 0.1078),
    ("service_probing", "iat_in_avg", "in", 104.9, 119.3, 0.0858),
    ("service_probing", "pps_flow", "<", 195.5, None, 0.0856),
    ("service_probing", "iat_in_std", "in", 177.5, 206.2, 0.065),
    ("service_probing", "dir_ratio_flow", "in", 1.342, 2.225, 0.0397),
    ("service_probing", "bpp_flow", "in", 97.71, 115.4, 0.0367),
    ("exploitation#Exploits", "tcp_flags", "in", 18.65, 23.65, 0.1568),
    ("exploitation#Exploits", "longest_pkt", ">", 576.6, None, 0.1154),
    ("exploitation#Exploits", "dst_port", "in", 2415.0, 2672.0, 0.1078),
    ("exploitation#Exploits", "iat_in_avg", "in", 87.1, 95.21, 0.0858),
    ("exploitation#Exploits", "pps_flow", "in", 195.5, 2096.0, 0.0856),
    ("exploitation#Exploits", "iat_in_std", "in", 140.6, 159.9, 0.065),
    ("exploitation#Exploits", "dir_ratio_flow", "in", 6.625, 13.48, 0.0397),
    ("exploitation#Exploits", "bpp_flow", "in", 238.1, 288.8, 0.0367),
    ("exploitation#Shellcode", "tcp_flags", "in", 12.59, 14.3, 0.1568),
    ("exploitation#Shellcode", "longest_pkt", "in", 217.4, 312.4, 0.1154),
    ("exploitation#Shellcode", "dst_port", ">", 14570.0, None, 0.1078),
    ("exploitation#Shellcode", "iat_in_avg", "in", 31.63, 61.6, 0.0858),
    ("exploitation#Shellcode", "pps_flow", "in", 5975.0, 6644.0, 0.0856),
    ("exploitation#Shellcode", "iat_in_std", "in", 53.33, 98.77, 0.065),
    ("exploitation#Shellcode", "dir_ratio_flow", "<", 0.6325, None, 0.0397),
    ("exploitation#Shellcode", "bpp_flow", "in", 115.4, 138.5, 0.0367),
    ("volumetric_flood#DoS", "tcp_flags", "in", 15.99, 18.65, 0.1568),
    ("volumetric_flood#DoS", "longest_pkt", "in", 480.4, 576.6, 0.1154),
    ("volumetric_flood#DoS", "dst_port", "in", 2672.0, 5633.0, 0.1078),
    ("volumetric_flood#DoS", "iat_in_avg", "in", 61.6, 81.3, 0.0858),
    ("volumetric_flood#DoS", "pps_flow", "in", 3094.0, 3632.0, 0.0856),
    ("volumetric_flood#DoS", "iat_in_std", "in", 98.77, 126.6, 0.065),
    ("volumetric_flood#DoS", "dir_ratio_flow", "in", 4.266, 5.444, 0.0397),
    ("volumetric_flood#DoS", "bpp_flow", "in", 185.5, 207.6, 0.0367),
    ("volumetric_flood#Generic", "tcp_flags", "<", 8.117, None, 0.1568),
    ("volumetric_flood#Generic", "longest_pkt", "in", 217.4, 312.4, 0.1154),
    ("volumetric_flood#Generic", "dst_port", "in", 1161.0, 1921.0, 0.1078),
    ("volumetric_flood#Generic", "iat_in_avg", "in", 14.38, 31.63, 0.0858),
    ("volumetric_flood#Generic", "pps_flow", ">", 10210.0, None, 0.0856),
    ("volumetric_flood#Generic", "iat_in_std", "in", 32.3, 53.33, 0.065),
    ("volumetric_flood#Generic", "dir_ratio_flow", "in", 2.225, 3.399, 0.0397),
    ("volumetric_flood#Generic", "bpp_flow", "in", 138.5, 163.3, 0.0367),
    ("fuzzing", "tcp_flags", "in", 12.59, 14.3, 0.1568),
    ("fuzzing", "longest_pkt", "in", 312.4, 392.5, 0.1154),
    ("fuzzing", "dst_port", "in", 265.7, 1161.0, 0.1078),
    ("fuzzing", "iat_in_avg", "in", 61.6, 81.3, 0.0858),
    ("fuzzing", "pps_flow", "in", 5062.0, 5975.0, 0.0856),
    ("fuzzing", "iat_in_std", "in", 98.77, 140.6, 0.065),
    ("fuzzing", "dir_ratio_flow", "in", 0.9798, 1.342, 0.0397),
    ("fuzzing", "bpp_flow", "in", 163.3, 185.5, 0.0367),
    ("worm_spreading", "tcp_flags", "in", 15.99, 18.65, 0.1568),
    ("worm_spreading", "longest_pkt", "in", 576.6, 700.3, 0.1154),
    ("worm_spreading", "dst_port", "in", 1161.0, 1921.0, 0.1078),
    ("worm_spreading", "iat_in_avg", "in", 95.21, 104.9, 0.0858),
    ("worm_spreading", "pps_flow", "in", 2096.0, 3094.0, 0.0856),
    ("worm_spreading", "iat_in_std", "in", 159.9, 177.5, 0.065),
    ("worm_spreading", "dir_ratio_flow", ">", 13.48, None, 0.0397),
    ("worm_spreading", "bpp_flow", ">", 288.8, None, 0.0367),
    ("normal_activity", "min_ttl", "<", 43.98, None, 2.1765),
    ("normal_activity", "tcp_flags", "in", 18.65, 23.65, 0.1568),
    ("normal_activity", "longest_pkt", ">", 670.0, None, 0.1154),
    ("normal_activity", "dst_port", "in", 5633.0, 14570.0, 0.1078),
    ("normal_activity", "iat_in_avg", "<", 14.38, None, 0.0858),
    ("normal_activity", "pps_flow", "in", 3632.0, 4132.0, 0.0856),
    ("normal_activity", "iat_in_std", "<", 32.3, None, 0.065),
    ("normal_activity", "dir_ratio_flow", "in", 5.444, 6.625, 0.0397),
    ("normal_activity", "bpp_flow", "in", 207.6, 238.1, 0.0367),
    ("backdoor_comm", "tcp_flags", "in", 14.3, 15.99, 0.1568),
    ("backdoor_comm", "longest_pkt", "in", 392.5, 480.4, 0.1154),
    ("backdoor_comm", "dst_port", "in", 2415.0, 2672.0, 0.1078),
    ("backdoor_comm", "iat_in_avg", ">", 119.3, None, 0.0858),
    ("backdoor_comm", "pps_flow", "in", 4132.0, 5062.0, 0.0856),
    ("backdoor_comm", "iat_in_std", ">", 206.2, None, 0.065),
    ("backdoor_comm", "dir_ratio_flow", "in", 3.399, 4.266, 0.0397),
    ("backdoor_comm", "bpp_flow", "in", 185.5, 207.6, 0.0367),
    ("port_scanning", "tcp_flags", "in", 8.117, 12.59, 0.1568),
    ("port_scanning", "longest_pkt", "<", 217.4, None, 0.1154),
    ("port_scanning", "dst_port", "in", 1921.0, 2415.0, 0.1078),
    ("port_scanning", "iat_in_avg", "in", 81.3, 87.1, 0.0858),
    ("port_scanning", "pps_flow", "in", 6644.0, 10210.0, 0.0856),
    ("port_scanning", "iat_in_std", "in", 121.9, 140.6, 0.065),
    ("port_scanning", "dir_ratio_flow", "in", 0.6325, 0.9798, 0.0397),
    ("port_scanning", "bpp_flow", "<", 97.71, None, 0.0367),
]

#: The same for CIC-IDS2018.
CICIDS_RULES = [
    ("bot_beaconing", "shortest_pkt", "<", 44.9, None, 2.3901),
    ("bot_beaconing", "bpp_flow", "in", 72.58, 93.62, 1.0765),
    ("bot_beaconing", "iat_avg", "in", 0.8158, 3.273, 0.8105),
    ("bot_beaconing", "fan_out", "in", 7.14, 19.42, 0.5278),
    ("bot_beaconing", "iat_max", "in", 5.142, 13.2, 0.3495),
    ("bot_beaconing", "tcp_win_in", "in", 7273.0, 9579.0, 0.317),
    ("bot_beaconing", "protocol", "<", 6.782, None, 0.2961),
    ("bot_beaconing", "iat_std", "in", 1.939, 5.098, 0.2768),
    ("bot_beaconing", "duration", "in", 3.44, 16.16, 0.2602),
    ("brute_force#Brute_Force_-Web", "shortest_pkt", "in", 84.82, 226.4, 2.3901),
    ("brute_force#Brute_Force_-Web", "bpp_flow", "in", 156.6, 173.6, 1.0765),
    ("brute_force#Brute_Force_-Web", "iat_avg", "in", 2716.0, 3798.0, 0.8105),
    ("brute_force#Brute_Force_-Web", "fan_out", "in", 2.613, 7.14, 0.5278),
    ("brute_force#Brute_Force_-Web", "iat_max", "in", 5724.0, 8274.0, 0.3495),
    ("brute_force#Brute_Force_-Web", "tcp_win_in", "in", 9579.0, 11860.0, 0.317),
    ("brute_force#Brute_Force_-Web", "protocol", "in", 6.782, 9.181, 0.2961),
    ("brute_force#Brute_Force_-Web", "iat_std", "in", 2048.0, 2915.0, 0.2768),
    ("brute_force#Brute_Force_-Web", "duration", "in", 14830.0, 18370.0, 0.2602),
    ("brute_force#FTP-BruteForce", "shortest_pkt", "<", 44.9, None, 2.3901),
    ("brute_force#FTP-BruteForce", "bpp_flow", "<", 54.77, None, 1.0765),
    ("brute_force#FTP-BruteForce", "iat_avg", "<", 0.1489, None, 0.8105),
    ("brute_force#FTP-BruteForce", "fan_out", "<", 1.095, None, 0.5278),
    ("brute_force#FTP-BruteForce", "iat_max", "<", 5.142, None, 0.3495),
    ("brute_force#FTP-BruteForce", "tcp_win_in", "in", 25640.0, 41970.0, 0.317),
    ("brute_force#FTP-BruteForce", "protocol", "<", 6.782, None, 0.2961),
    ("brute_force#FTP-BruteForce", "iat_std", "<", 1.939, None, 0.2768),
    ("brute_force#FTP-BruteForce", "duration", "<", 3.44, None, 0.2602),
    ("brute_force#SSH-Bruteforce", "shortest_pkt", "in", 44.9, 53.33, 2.3901),
    ("brute_force#SSH-Bruteforce", "bpp_flow", "in", 142.0, 156.6, 1.0765),
    ("brute_force#SSH-Bruteforce", "iat_avg", "in", 8.571, 96.48, 0.8105),
    ("brute_force#SSH-Bruteforce", "fan_out", "<", 1.095, None, 0.5278),
    ("brute_force#SSH-Bruteforce", "iat_max", "in", 41.7, 273.6, 0.3495),
    ("brute_force#SSH-Bruteforce", "tcp_win_in", "in", 25640.0, 41970.0, 0.317),
    ("brute_force#SSH-Bruteforce", "protocol", "<", 6.782, None, 0.2961),
    ("brute_force#SSH-Bruteforce", "iat_std", "in", 23.33, 148.6, 0.2768),
    ("brute_force#SSH-Bruteforce", "duration", "in", 89.79, 1393.0, 0.2602),
    ("internal_spreading", "shortest_pkt", "in", 53.33, 57.83, 2.3901),
    ("internal_spreading", "bpp_flow", "in", 93.62, 111.5, 1.0765),
    ("internal_spreading", "iat_avg", "in", 96.48, 678.8, 0.8105),
    ("internal_spreading", "fan_out", ">", 27.61, None, 0.5278),
    ("internal_spreading", "iat_max", "in", 1280.0, 3221.0, 0.3495),
    ("internal_spreading", "tcp_win_in", "in", 2637.0, 5213.0, 0.317),
    ("internal_spreading", "protocol", "in", 9.181, 12.95, 0.2961),
    ("internal_spreading", "iat_std", "in", 148.6, 1142.0, 0.2768),
    ("internal_spreading", "duration", "in", 1393.0, 8338.0, 0.2602),
    ("normal_activity", "shortest_pkt", "in", 53.33, 57.83, 2.3901),
    ("normal_activity", "bpp_flow", "in", 129.4, 142.0, 1.0765),
    ("normal_activity", "iat_avg", "in", 947.0, 1330.0, 0.8105),
    ("normal_activity", "fan_out", "in", 19.42, 27.61, 0.5278),
    ("normal_activity", "iat_max", "in", 4761.0, 5724.0, 0.3495),
    ("normal_activity", "tcp_win_in", "in", 5213.0, 7273.0, 0.317),
    ("normal_activity", "protocol", "in", 9.181, 12.95, 0.2961),
    ("normal_activity", "iat_std", "in", 1647.0, 1838.0, 0.2768),
    ("normal_activity", "duration", "in", 13430.0, 14830.0, 0.2602),
    ("volumetric_flood#DDOS_attack-HOIC", "shortest_pkt", "<", 44.9, None, 2.3901),
    ("volumetric_flood#DDOS_attack-HOIC", "bpp_flow", "in", 156.6, 173.6, 1.0765),
    ("volumetric_flood#DDOS_attack-HOIC", "iat_avg", "in", 3.273, 8.571, 0.8105),
    ("volumetric_flood#DDOS_attack-HOIC", "fan_out", "in", 1.553, 2.613, 0.5278),
    ("volumetric_flood#DDOS_attack-HOIC", "iat_max", "in", 13.2, 41.7, 0.3495),
    ("volumetric_flood#DDOS_attack-HOIC", "tcp_win_in", ">", 41970.0, None, 0.317),
    ("volumetric_flood#DDOS_attack-HOIC", "protocol", "<", 6.782, None, 0.2961),
    ("volumetric_flood#DDOS_attack-HOIC", "iat_std", "in", 5.098, 11.72, 0.2768),
    ("volumetric_flood#DDOS_attack-HOIC", "duration", "in", 16.16, 89.79, 0.2602),
    ("volumetric_flood#DDOS_attack-LOIC-UDP", "shortest_pkt", "in", 57.83, 84.82, 2.3901),
    ("volumetric_flood#DDOS_attack-LOIC-UDP", "bpp_flow", "in", 54.77, 72.58, 1.0765),
    ("volumetric_flood#DDOS_attack-LOIC-UDP", "iat_avg", "in", 0.1489, 0.8158, 0.8105),
    ("volumetric_flood#DDOS_attack-LOIC-UDP", "fan_out", "in", 1.553, 2.613, 0.5278),
    ("volumetric_flood#DDOS_attack-LOIC-UDP", "iat_max", "in", 273.6, 1280.0, 0.3495),
    ("volumetric_flood#DDOS_attack-LOIC-UDP", "tcp_win_in", "<", 462.8, None, 0.317),
    ("volumetric_flood#DDOS_attack-LOIC-UDP", "protocol", ">", 16.37, None, 0.2961),
    ("volumetric_flood#DDOS_attack-LOIC-UDP", "iat_std", "in", 11.72, 23.33, 0.2768),
    ("volumetric_flood#DDOS_attack-LOIC-UDP", "duration", ">", 100800.0, None, 0.2602),
    ("volumetric_flood#DDoS_attacks-LOIC-HTTP", "shortest_pkt", "<", 44.9, None, 2.3901),
    ("volumetric_flood#DDoS_attacks-LOIC-HTTP", "bpp_flow", "in", 142.0, 156.6, 1.0765),
    ("volumetric_flood#DDoS_attacks-LOIC-HTTP", "iat_avg", "in", 3798.0, 8596.0, 0.8105),
    ("volumetric_flood#DDoS_attacks-LOIC-HTTP", "fan_out", "in", 1.553, 2.613, 0.5278),
    ("volumetric_flood#DDoS_attacks-LOIC-HTTP", "iat_max", "in", 13920.0, 25630.0, 0.3495),
    ("volumetric_flood#DDoS_attacks-LOIC-HTTP", "tcp_win_in", "in", 7273.0, 9579.0, 0.317),
    ("volumetric_flood#DDoS_attacks-LOIC-HTTP", "protocol", "<", 6.782, None, 0.2961),
    ("volumetric_flood#DDoS_attacks-LOIC-HTTP", "iat_std", "in", 5725.0, 9569.0, 0.2768),
    ("volumetric_flood#DDoS_attacks-LOIC-HTTP", "duration", "in", 18370.0, 40070.0, 0.2602),
    ("volumetric_flood#DoS_attacks-GoldenEye", "shortest_pkt", "in", 44.9, 53.33, 2.3901),
    ("volumetric_flood#DoS_attacks-GoldenEye", "bpp_flow", "in", 192.3, 332.1, 1.0765),
    ("volumetric_flood#DoS_attacks-GoldenEye", "iat_avg", "in", 1988.0, 2716.0, 0.8105),
    ("volumetric_flood#DoS_attacks-GoldenEye", "fan_out", "<", 1.095, None, 0.5278),
    ("volumetric_flood#DoS_attacks-GoldenEye", "iat_max", "in", 8274.0, 13920.0, 0.3495),
    ("volumetric_flood#DoS_attacks-GoldenEye", "tcp_win_in", "in", 17540.0, 25640.0, 0.317),
    ("volumetric_flood#DoS_attacks-GoldenEye", "protocol", "<", 6.782, None, 0.2961),
    ("volumetric_flood#DoS_attacks-GoldenEye", "iat_std", "in", 2915.0, 5725.0, 0.2768),
    ("volumetric_flood#DoS_attacks-GoldenEye", "duration", "in", 8338.0, 13430.0, 0.2602),
    ("volumetric_flood#DoS_attacks-Hulk", "shortest_pkt", "in", 44.9, 53.33, 2.3901),
    ("volumetric_flood#DoS_attacks-Hulk", "bpp_flow", "in", 173.6, 192.3, 1.0765),
    ("volumetric_flood#DoS_attacks-Hulk", "iat_avg", "in", 678.8, 947.0, 0.8105),
    ("volumetric_flood#DoS_attacks-Hulk", "fan_out", "<", 1.095, None, 0.5278),
    ("volumetric_flood#DoS_attacks-Hulk", "iat_max", "in", 3221.0, 4761.0, 0.3495),
    ("volumetric_flood#DoS_attacks-Hulk", "tcp_win_in", "in", 25640.0, 41970.0, 0.317),
    ("volumetric_flood#DoS_attacks-Hulk", "protocol", "<", 6.782, None, 0.2961),
    ("volumetric_flood#DoS_attacks-Hulk", "iat_std", "in", 1142.0, 1647.0, 0.2768),
    ("volumetric_flood#DoS_attacks-Hulk", "duration", "in", 82100.0, 100800.0, 0.2602),
    ("volumetric_flood#DoS_attacks-SlowHTTPTest", "shortest_pkt", "<", 44.9, None, 2.3901),
    ("volumetric_flood#DoS_attacks-SlowHTTPTest", "bpp_flow", "<", 54.77, None, 1.0765),
    ("volumetric_flood#DoS_attacks-SlowHTTPTest", "iat_avg", "<", 0.1489, None, 0.8105),
    ("volumetric_flood#DoS_attacks-SlowHTTPTest", "fan_out", "<", 1.095, None, 0.5278),
    ("volumetric_flood#DoS_attacks-SlowHTTPTest", "iat_max", "<", 5.142, None, 0.3495),
    ("volumetric_flood#DoS_attacks-SlowHTTPTest", "tcp_win_in", "in", 25640.0, 41970.0, 0.317),
    ("volumetric_flood#DoS_attacks-SlowHTTPTest", "protocol", "<", 6.782, None, 0.2961),
    ("volumetric_flood#DoS_attacks-SlowHTTPTest", "iat_std", "<", 1.939, None, 0.2768),
    ("volumetric_flood#DoS_attacks-SlowHTTPTest", "duration", "<", 3.44, None, 0.2602),
    ("volumetric_flood#DoS_attacks-Slowloris", "shortest_pkt", "in", 44.9, 53.33, 2.3901),
    ("volumetric_flood#DoS_attacks-Slowloris", "bpp_flow", "in", 111.5, 129.4, 1.0765),
    ("volumetric_flood#DoS_attacks-Slowloris", "iat_avg", "in", 1330.0, 1988.0, 0.8105),
    ("volumetric_flood#DoS_attacks-Slowloris", "fan_out", "<", 1.095, None, 0.5278),
    ("volumetric_flood#DoS_attacks-Slowloris", "iat_max", "in", 5724.0, 8274.0, 0.3495),
    ("volumetric_flood#DoS_attacks-Slowloris", "tcp_win_in", "in", 11860.0, 17540.0, 0.317),
    ("volumetric_flood#DoS_attacks-Slowloris", "protocol", "<", 6.782, None, 0.2961),
    ("volumetric_flood#DoS_attacks-Slowloris", "iat_std", "in", 1838.0, 2048.0, 0.2768),
    ("volumetric_flood#DoS_attacks-Slowloris", "duration", "in", 14830.0, 18370.0, 0.2602),
    ("web_exploitation#Brute_Force_-XSS", "shortest_pkt", ">", 441.4, None, 2.3901),
    ("web_exploitation#Brute_Force_-XSS", "bpp_flow", ">", 332.1, None, 1.0765),
    ("web_exploitation#Brute_Force_-XSS", "iat_avg", ">", 8596.0, None, 0.8105),
    ("web_exploitation#Brute_Force_-XSS", "fan_out", "in", 1.095, 1.553, 0.5278),
    ("web_exploitation#Brute_Force_-XSS", "iat_max", ">", 25630.0, None, 0.3495),
    ("web_exploitation#Brute_Force_-XSS", "tcp_win_in", "in", 462.8, 1250.0, 0.317),
    ("web_exploitation#Brute_Force_-XSS", "protocol", "in", 15.24, 16.37, 0.2961),
    ("web_exploitation#Brute_Force_-XSS", "iat_std", ">", 9569.0, None, 0.2768),
    ("web_exploitation#Brute_Force_-XSS", "duration", "in", 40070.0, 82100.0, 0.2602),
    ("web_exploitation#SQL_Injection", "shortest_pkt", "in", 226.4, 441.4, 2.3901),
    ("web_exploitation#SQL_Injection", "bpp_flow", ">", 332.1, None, 1.0765),
    ("web_exploitation#SQL_Injection", "iat_avg", ">", 8596.0, None, 0.8105),
    ("web_exploitation#SQL_Injection", "fan_out", "in", 1.095, 1.553, 0.5278),
    ("web_exploitation#SQL_Injection", "iat_max", ">", 25630.0, None, 0.3495),
    ("web_exploitation#SQL_Injection", "tcp_win_in", "in", 1250.0, 2637.0, 0.317),
    ("web_exploitation#SQL_Injection", "protocol", "in", 12.95, 15.24, 0.2961),
    ("web_exploitation#SQL_Injection", "iat_std", ">", 9569.0, None, 0.2768),
    ("web_exploitation#SQL_Injection", "duration", "in", 40070.0, 82100.0, 0.2602),
]

#: Behaviour -> tactic weights, in the order in which behaviours are listed.
TACTIC_WEIGHTS = {
    "bot_iot": {
        "syn_flooding": {"Impact": 1.0}, "volumetric_flood": {"Impact": 1.0}, "port_scanning": {"Reconnaissance": 1.0},
        "service_probing": {"Reconnaissance": 0.6, "Discovery": 0.4}, "data_transfer": {"Exfiltration": 1.0}, "normal_activity": {"None": 1.0},
        "connection_attempts": {"Reconnaissance": 0.5, "Impact": 0.5}, "periodic_comm": {"Command and Control": 1.0},
        "fuzzing": {"Initial Access": 1.0}, "exploitation": {"Execution": 0.6, "Initial Access": 0.4},
        "backdoor_comm": {"Persistence": 1.0}, "worm_spreading": {"Lateral Movement": 1.0},
    },
}
TACTIC_WEIGHTS["unsw"] = TACTIC_WEIGHTS["bot_iot"] | {
    "service_probing": {"Reconnaissance": 0.4, "Discovery": 0.6}, "data_transfer": {"Exfiltration": 0.5, "Lateral Movement": 0.5},
}
TACTIC_WEIGHTS["cicids"] = TACTIC_WEIGHTS["bot_iot"] | {
    "data_transfer": {"Exfiltration": 0.3, "Lateral Movement": 0.7}, "connection_attempts": {"Credential Access": 0.7, "Reconnaissance": 0.3},
}
TACTIC_WEIGHTS["cicids_v3"] = {
    "normal_activity": {"None": 1.0}, "volumetric_flood": {"Impact": 1.0}, "brute_force": {"Credential Access": 1.0},
    "bot_beaconing": {"Command and Control": 1.0}, "internal_spreading": {"Lateral Movement": 1.0}, "web_exploitation": {"Initial Access": 1.0},
}
#: Weights of the window scorer; its tactics are scaled by the largest one.
TACTIC_WEIGHTS["window"] = TACTIC_WEIGHTS["bot_iot"] | {"connection_attempts": {"Reconnaissance": 0.5, "Initial Access": 0.5}, "exploitation": {"Execution": 1.0}}
TACTICS = [
    "Reconnaissance", "Initial Access", "Execution", "Persistence", "Credential Access", "Discovery", "Lateral Movement",
    "Command and Control", "Exfiltration", "Impact", "None",
]

#: attack -> (tactic, tactic id, technique id, technique name)
ATTACKS = {
    "DDoS": ("Impact", "TA0040", "T1499", "Endpoint Denial of Service"),
    "DoS": ("Impact", "TA0040", "T1499", "Endpoint Denial of Service"),
    "Reconnaissance": ("Reconnaissance", "TA0043", "T1046/T1016", "Network Service Scanning / System Network Discovery"),
    "Theft": ("Exfiltration", "TA0010", "T1041", "Exfiltration Over Network"),
    "Benign": ("None", "None", "None", "None"),
}

#: The same for the UNSW-NB15 and CIC-IDS2018 attack names.
ATTACKS_UNSW = {
    "Reconnaissance": ("Reconnaissance", "TA0043", "T1046", "Network Service Scanning"),
    "Fuzzers": ("Initial Access", "TA0001", "T1190", "Exploit Public-Facing Application"),
    "Exploits": ("Execution", "TA0002", "T1203", "Exploitation for Client Execution"),
    "Generic": ("Impact", "TA0040", "T1499", "Endpoint Denial of Service"),
    "DoS": ("Impact", "TA0040", "T1499", "Endpoint Denial of Service"),
    "Analysis": ("Discovery", "TA0007", "T1046", "Network Service Scanning"),
    "Backdoor": ("Persistence", "TA0003", "T1105", "Ingress Tool Transfer"),
    "Backdoors": ("Persistence", "TA0003", "T1105", "Ingress Tool Transfer"),
    "Shellcode": ("Execution", "TA0002", "T1059", "Command and Scripting Interpreter"),
    "Worms": ("Lateral Movement", "TA0008", "T1570", "Lateral Tool Transfer"),
    "Benign": ("None", "None", "None", "None"),
}
ATTACKS_CICIDS = {
    "Benign": ("None", "", "", "Normal Traffic"),
    "DDoS attacks-LOIC-HTTP": ("Impact", "TA0040", "T1498", "Network Denial of Service"),
    "DDOS attack-LOIC-UDP": ("Impact", "TA0040", "T1498", "Network Denial of Service"),
    "DDOS attack-HOIC": ("Impact", "TA0040", "T1498", "Network Denial of Service"),
    "DoS attacks-Hulk": ("Impact", "TA0040", "T1499", "Endpoint Denial of Service"),
    "DoS attacks-SlowHTTPTest": ("Impact", "TA0040", "T1499", "Endpoint Denial of Service"),
    "DoS attacks-Slowloris": ("Impact", "TA0040", "T1499", "Endpoint Denial of Service"),
    "DoS attacks-GoldenEye": ("Impact", "TA0040", "T1499", "Endpoint Denial of Service"),
    "Bot": ("Command and Control", "TA0011", "T1071", "Application Layer Protocol"),
    "Infilteration": ("Lateral Movement", "TA0008", "T1570", "Lateral Tool Transfer"),
    "FTP-BruteForce": ("Credential Access", "TA0006", "T1110", "Brute Force"),
    "SSH-Bruteforce": ("Credential Access", "TA0006", "T1110", "Brute Force"),
    "Brute Force -Web": ("Credential Access", "TA0006", "T1110", "Brute Force - Web"),
    "Brute Force -XSS": ("Initial Access", "TA0001", "T1189", "Drive-by Compromise"),
    "SQL Injection": ("Initial Access", "TA0001", "T1190", "Exploit Public-Facing Application"),
}

#: Additive scorer: behaviour -> (guard, steps, dampings); in a step the first predicate that holds adds its value, dampings multiply.
EXPERT_BOT_IOT = {
    "syn_flooding": ("true", [[("tcp_flags < 4", 0.5)], [("tcp_flags < 2", 0.2)], [("out_bytes < 10", 0.15)], [("min_ttl > 50", 0.1)], [("dir_ratio > 100", 0.05)]], None),
    "volumetric_flood": ("true", [[("tcp_flags >= 4 AND min_ttl > 50", 0.3)], [("dir_ratio > 100", 0.2)], [("pps > 5000 AND out_bytes < 1000", 0.2)], [("fan_out < 5", 0.1)]], None),
    "port_scanning": ("tcp_flags >= 4", [[("tcp_flags > 15 AND out_bytes < 200", 0.35)], [("pps > 5000", 0.2)], [("n_dst > 5", 0.15)], [("fan_out > 3", 0.15)], [("min_ttl > 20", 0.1)]], None),
    "service_probing": ("tcp_flags >= 4", [[("tcp_flags > 15 AND out_bytes < 5000", 0.35)], [("n_dst > 3", 0.2)], [("pps > 1000", 0.15)], [("fan_out > 2", 0.15)]], None),
    "data_transfer": (
        "tcp_flags >= 4",
        [
            [("out_bytes > 200000", 0.5), ("out_bytes > 50000", 0.35), ("out_bytes > 10000 AND min_ttl > 30", 0.2)],
            [("in_bytes > 200000", 0.5), ("in_bytes > 50000", 0.35), ("in_bytes > 10000 AND min_ttl > 30", 0.2)],
            [("fan_out > 10", 0.15)], [("dir_ratio > 3 AND min_ttl > 30", 0.15)], [("tcp_flags > 10", 0.1)],
        ],
        [("min_ttl < 20", 0.3)],
    ),
    "normal_activity": (
        "true",
        [
            [("min_ttl < 20", 0.35), ("min_ttl < 25", 0.2)], [("proportion > 0.05D", 0.2), ("proportion > 0.02D", 0.1)],
            [("out_bytes > 50 AND out_bytes < 100000 AND tcp_flags >= 4", 0.15)], [("tcp_flags > 15 AND tcp_flags < 100", 0.1)],
            [("dir_ratio > 0.3D AND dir_ratio < 3", 0.1)], [("tcp_flags < 4 AND min_ttl < 20", 0.3)], [("out_bytes > 10000 AND min_ttl < 20", 0.15)],
        ],
        None,
    ),
    "connection_attempts": ("true", [[("tcp_flags < 4 AND fan_out <= 3", 0.5)], [("out_bytes < 10", 0.2)]], None),
    "periodic_comm": (
        "tcp_flags >= 4",
        [[("dir_ratio > 0.5D AND dir_ratio < 2", 0.3)], [("fan_out <= 2 AND n_dst <= 3", 0.25)], [("pps < 100", 0.2)], [("tcp_flags > 10", 0.1)], [("out_bytes < 1000", 0.1)]],
        [("min_ttl < 20", 0.3)],
    ),
}
#: The same for UNSW-NB15; all but three behaviours need a flow group that few sources reach with a high TTL.
_FEW_SOURCES = "fan_in < 6 AND min_ttl > 100"
_IP_SUITE = "protocol <= 50"
EXPERT_UNSW = {
    "normal_activity": ("true", [[("fan_in >= 8", 0.35)], [("min_ttl < 50", 0.25)], [("dir_ratio < 15", 0.15)], [("tcp_flags > 15", 0.1)], [("proportion > 0.05D", 0.1)]], [(_FEW_SOURCES, 0.1)]),
    "port_scanning": (_FEW_SOURCES, [[("out_bytes < 300", 0.3)], [("bpp < 100", 0.2)], [("min_ttl > 200", 0.15)], [("tcp_flags > 5 AND tcp_flags < 15", 0.15)], [("dir_ratio > 100", 0.1)]], None),
    "service_probing": (_FEW_SOURCES, [[("protocol > 50", 0.35)], [("tcp_flags < 6", 0.2)], [("dir_ratio > 500", 0.15)], [("out_bytes < 500", 0.15)]], None),
    "exploitation": (_FEW_SOURCES, [[("tcp_flags > 15", 0.25)], [("longest_pkt > 500", 0.2)], [("bpp > 200", 0.2)], [("in_bytes > 10000", 0.15)], [(_IP_SUITE, 0.1)]], None),
    "volumetric_flood": (
        _FEW_SOURCES,
        [
            [(f"dir_ratio > 100 AND {_IP_SUITE}", 0.2)], [("tcp_flags < 15 AND out_bytes > 5000", 0.2)],
            [("out_bytes > 3000 AND out_bytes < 60000", 0.15)], [(f"tcp_flags < 15 AND {_IP_SUITE}", 0.15)],
        ],
        None,
    ),
    "syn_flooding": (f"tcp_flags < 4 AND {_FEW_SOURCES}", [[("true", 0.4)], [("dir_ratio > 500", 0.2)], [("out_bytes < 1000", 0.15)]], None),
    "fuzzing": (
        _FEW_SOURCES,
        [
            [("shortest_pkt > 90", 0.25)], [("out_bytes > 100 AND out_bytes < 2000", 0.2)], [("dir_ratio > 100 AND dir_ratio < 500", 0.2)],
            [("tcp_flags > 10 AND tcp_flags < 18", 0.15)], [(_IP_SUITE, 0.1)],
        ],
        None,
    ),
    "backdoor_comm": (_FEW_SOURCES, [[("protocol > 50", 0.3)], [("tcp_flags < 4", 0.25)], [("dir_ratio > 500", 0.2)], [("shortest_pkt > 100", 0.1)]], None),
    "worm_spreading": (_FEW_SOURCES, [[("out_bytes > 40000", 0.3)], [("bpp > 250", 0.2)], [("duration > 500000", 0.2)], [(f"tcp_flags > 10 AND {_IP_SUITE}", 0.15)]], None),
    "data_transfer": (_FEW_SOURCES, [[("out_bytes > 100000", 0.4)], [("dir_ratio > 10 AND bpp > 200", 0.2)]], None),
    "connection_attempts": ("true", [[("tcp_flags < 4 AND fan_in < 6 AND out_bytes < 100", 0.5)]], None),
    "periodic_comm": (f"{_FEW_SOURCES} AND {_IP_SUITE}", [[("dir_ratio > 0.5D AND dir_ratio < 5", 0.3)], [("fan_out <= 2", 0.2)], [("pps < 1000", 0.15)]], None),
}
#: The same for the third CIC-IDS2018 set, over medians and the share of UDP flows; dampings multiply.
_WEB, _LOGIN, _BOT_PORT = "dst_port BETWEEN 75 AND 85", "dst_port BETWEEN 20 AND 23", "dst_port BETWEEN 8000 AND 8100"
_UDP_FLOOD = "share_udp > 0.5D AND in_bytes > 100000"
EXPERT_CICIDS_V3 = {
    "periodic_comm": ("true", [[(_BOT_PORT, 0.5)], [("tcp_flags > 200", 0.2)], [("iat_avg < 10 AND duration < 100", 0.15)], [("min_ttl >= 120", 0.15)]], [(_WEB, 0.2)]),
    "connection_attempts": ("true", [[(_LOGIN, 0.5)], [("fan_out <= 2", 0.2)], [("tcp_flags < 35", 0.15)], [("duration < 2000", 0.15)]], [(f"NOT ({_LOGIN})", 0.2)]),
    "syn_flooding": (
        "true",
        [[(_WEB, 0.4)], [("tcp_flags < 35", 0.2)], [("bpp > 0 AND bpp < 140", 0.2)], [("fan_out <= 2", 0.1)]],
        [(f"share_udp > 0.5D OR NOT ({_WEB})", 0.2), ("fan_out > 3", 0.3)],
    ),
    "volumetric_flood": (
        "true",
        [[(_WEB, 0.4)], [("tcp_flags > 200 AND fan_out <= 3", 0.3)], [("tcp_flags < 35 AND bpp >= 140", 0.3)], [(_UDP_FLOOD, 0.6)]],
        [(f"NOT ({_UDP_FLOOD}) AND NOT ({_WEB})", 0.2), ("fan_out > 3", 0.3)],
    ),
    "fuzzing": ("true", [[("shortest_pkt > 200", 0.5)], [("bpp > 300", 0.3)], [("duration > 30000", 0.1)], [("tcp_win_in < 1000", 0.1)]], None),
    "worm_spreading": (
        "true",
        [[("fan_out > 20", 0.3)], [("share_udp < 0.5D AND tcp_win_in BETWEEN 1000 AND 1100", 0.3)], [("duration < 10", 0.2)], [("min_ttl < 10", 0.2)]],
        [("share_udp > 0.5D", 0.3), ("fan_out <= 20", 0.3)],
    ),
    "normal_activity": (
        "true",
        [
            [("share_udp > 0.5D AND dst_port BETWEEN 50 AND 56", 0.5)], [(f"min_ttl >= 100 AND NOT ({_WEB}) AND NOT ({_BOT_PORT})", 0.3)],
            [(f"NOT ({_WEB}) AND NOT ({_LOGIN}) AND NOT ({_BOT_PORT})", 0.2)], [(f"{_WEB} AND fan_out > 3", 0.3)],
        ],
        [(f"shortest_pkt > 200 OR ({_UDP_FLOOD})", 0.2)],
    ),
}
#: The same for the first CIC-IDS2018 set.
_HTTP, _SSH, _FTP = "dst_port > 75 AND dst_port < 85", "dst_port > 20 AND dst_port < 25", "dst_port > 19 AND dst_port < 23"
_FAN, _HIGH, _SLOW = "fan_out > 30", "tcp_flags > 200", "duration > 4000000 AND tcp_flags <= 200 AND fan_out <= 2"
EXPERT_CICIDS = {
    "syn_flooding": (
        "true",
        [[(f"{_HIGH} AND {_HTTP} AND fan_out <= 5", 0.6), (f"{_HIGH} AND fan_out <= 5", 0.3)], [("in_bytes > 100000", 0.15)], [(f"duration > 4000000 AND {_HIGH}", 0.1)]],
        [(f"dst_port > 5000 AND {_FAN}", 0.1)],
    ),
    "volumetric_flood": (
        "true",
        [
            [(f"{_SLOW} AND {_HTTP}", 0.6), (f"{_SLOW} AND {_FTP}", 0.3), (_SLOW, 0.2)], [(f"tcp_flags > 20 AND tcp_flags < 35 AND {_HTTP} AND fan_out <= 2", 0.15)],
            [(f"duration > 2000000 AND pps < 100 AND fan_out <= 2 AND {_HTTP}", 0.1)],
        ],
        [(f"{_SSH} AND pps > 100000", 0.2)],
    ),
    "connection_attempts": (
        "true",
        [
            [
                (f"{_SSH} AND fan_out <= 5 AND pps > 100000", 0.8), (f"{_SSH} AND fan_out <= 5", 0.6),
                (f"{_FTP} AND duration > 4000000 AND fan_out <= 2 AND pps < 100", 0.65), (f"{_FTP} AND duration > 4000000 AND fan_out <= 2", 0.5),
                (f"{_HIGH} AND duration > 2000000 AND fan_out <= 3 AND NOT ({_HTTP}) AND dst_port <= 5000", 0.4),
            ],
        ],
        None,
    ),
    "periodic_comm": (
        "true",
        [
            [(f"{_FAN} AND {_HIGH}", 0.5), (f"dst_port > 5000 AND {_HIGH}", 0.4)], [(f"{_FAN} AND {_HIGH} AND dst_port > 5000", 0.25)],
            [(f"{_FAN} AND {_HIGH} AND min_ttl > 100", 0.1)], [(f"{_FAN} AND {_HIGH} AND fan_in <= 15", 0.1)],
        ],
        None,
    ),
    "data_transfer": (
        "true",
        [[(f"{_FAN} AND fan_in > 100", 0.6)], [(f"{_FAN} AND fan_in > 200", 0.2)], [(f"{_FAN} AND min_ttl < 50", 0.1)], [(f"{_FAN} AND duration <= 2000000", 0.1)]],
        [(f"{_HIGH} AND dst_port > 5000", 0.2)],
    ),
    "normal_activity": (
        "true",
        [
            [("fan_in > 100 AND fan_out <= 30", 0.3)], [("duration <= 2000000 AND tcp_flags <= 200", 0.2)], [("tcp_flags > 50 AND tcp_flags < 180", 0.15)],
            [("proportion > 0.03D", 0.1)], [("dst_port > 500 AND dst_port <= 5000", 0.1)],
        ],
        [("duration > 4000000 AND fan_out <= 2", 0.1), (f"{_HIGH} AND {_FAN}", 0.1)],
    ),
    "port_scanning": ("fan_in <= 100", [[("n_dst > 10 AND out_bytes < 500", 0.4)], [("fan_out > 5 AND bpp < 100", 0.2)]], None),
    "service_probing": ("true", [[("fan_out > 3 AND fan_out < 30 AND out_bytes < 2000 AND fan_in <= 100", 0.3)], [("duration <= 2000000 AND tcp_flags <= 200", 0.15)]], None),
}
#: Additive scorer of windows, over ``windows.window_measures``; a value may be an expression.
_TCP, _SYN, _MID_TTL = "normal_tcp_fraction > 0.5D", "syn_only_fraction > 0.3D", "mean_min_ttl > 20 AND mean_min_ttl < 50"
_NO_SYN = "syn_only_fraction <= 0.3D"
WINDOW_BEHAVIOURS = {
    "syn_flooding": ("true", [[("true", "syn_only_fraction * 0.6D")], [("true", "zero_payload_fraction * 0.15D")], [("true", "low_port_fraction * 0.1D")], [("mean_min_ttl > 50", 0.15)]], None),
    "volumetric_flood": ("true", [[("mean_total_pkts > 100", 0.3)], [(f"{_TCP} AND mean_min_ttl > 50", 0.3)], [("direction_ratio > 10", 0.2)], [("low_port_fraction > 0.5D", 0.2)]], None),
    "port_scanning": (_NO_SYN, [[("fan_out > 5", 0.3), ("fan_out > 2", 0.15)], [(f"mean_out_bytes < 200 AND {_TCP}", 0.25)], [(_MID_TTL, 0.2)], [("n_flows > 10", 0.1)], [("high_port_fraction > 0.3D", 0.15)]], None),
    "service_probing": (_NO_SYN, [[(f"{_TCP} AND mean_out_bytes < 5000", 0.35)], [(_MID_TTL, 0.25)], [("fan_out > 2 AND fan_out < 10", 0.2)], [("port_diversity > 0.3D", 0.1)]], None),
    "data_transfer": ("true", [[("total_out_bytes > 500000", 0.45), ("total_out_bytes > 100000", 0.3)], [("mean_bytes_per_pkt > 200", 0.2)], [("direction_ratio > 3 AND mean_min_ttl > 30", 0.2)], [(_TCP, 0.1)]], [(_SYN, 0.1)]),
    "normal_activity": (
        "true",
        [
            [("mean_min_ttl < 25", 0.35)], [("high_port_fraction > 0.5D", 0.2)], [(f"{_TCP} AND syn_only_fraction < 0.1D", 0.15)],
            [("mean_out_bytes > 100 AND mean_out_bytes < 100000", 0.15)], [("direction_ratio > 0.3D AND direction_ratio < 3", 0.15)],
        ],
        [(_SYN, 0.2)],
    ),
    "connection_attempts": ("true", [[(f"{_SYN} AND fan_out <= 3", 0.5)], [("zero_payload_fraction > 0.5D", 0.2)], [("n_flows < 10", 0.15)]], None),
    "periodic_comm": ("true", [[("mean_duration_ms > 10000", 0.3)], [("direction_ratio > 0.3D AND direction_ratio < 3", 0.2)], [("fan_out <= 2", 0.25)], [(_TCP, 0.15)], [("mean_out_bytes < 1000", 0.1)]], [(_SYN, 0.2)]),
    "fuzzing": (_NO_SYN, [[("port_diversity > 0.5D", 0.25)], [("pkt_size_std > 100", 0.2)], [("low_port_fraction > 0.3D", 0.2)], [(f"{_TCP} AND mean_out_bytes > 50", 0.15)], [("fan_out <= 3", 0.1)]], None),
    "exploitation": (_NO_SYN, [[("mean_out_bytes > 200 AND mean_out_bytes < 50000", 0.25)], [("low_port_fraction > 0.5D", 0.2)], [("fan_out <= 3", 0.2)], [(_TCP, 0.15)], [("mean_duration_ms < 5000", 0.1)]], None),
    "backdoor_comm": (_NO_SYN, [[("mean_duration_ms > 5000", 0.25)], [("fan_out <= 2", 0.25)], [("direction_ratio > 0.3D AND direction_ratio < 5", 0.2)], [(_TCP, 0.15)], [("high_port_fraction > 0.3D", 0.1)]], None),
    "worm_spreading": (_NO_SYN, [[("fan_out > 5", 0.3)], [("mean_out_bytes > 200", 0.15)], [(_TCP, 0.15)], [("protocol_diversity > 0.2D", 0.1)], [("n_flows > 10", 0.15)], [("low_port_fraction > 0.3D", 0.1)]], None),
}
#: Where benign evidence dominates these scores, attack scores are damped.
BENIGN_RIVALS = ["syn_flooding", "data_transfer", "service_probing", "port_scanning"]
BENIGN_DAMPING = {"syn_flooding": 0.5, "volumetric_flood": 0.5, "service_probing": 0.5, "port_scanning": 0.5, "data_transfer": 0.6}

# -----------------------------------------------------------------------------------------------------------------------


RULES = {"bot_iot": BOT_IOT_RULES, "unsw": UNSW_RULES, "cicids": CICIDS_RULES}


def rule_table(spark: SparkSession, dataset: str = "bot_iot") -> DataFrame:
    return spark.createDataFrame(RULES[dataset], "profile string, feature string, op string, lo double, hi double, weight double")


def tactic_table(spark: SparkSession, dataset: str = "bot_iot") -> DataFrame:
    rows = [(b, t, w, i) for i, (b, weights) in enumerate(TACTIC_WEIGHTS[dataset].items()) for t, w in weights.items()]
    return spark.createDataFrame(rows, "behaviour string, tactic string, weight double, ord int")


ATTACK_TABLES = {
    "bot_iot": ATTACKS,
    "unsw": ATTACKS_UNSW,
    "cicids": ATTACKS_CICIDS | {a.replace(" ", "_"): v for a, v in ATTACKS_CICIDS.items()},  # either spelling
}


def attack_table(spark: SparkSession, dataset: str = "bot_iot") -> DataFrame:
    return spark.createDataFrame([(a, *v) for a, v in ATTACK_TABLES[dataset].items()], "attack string, tactic string, tactic_id string, technique_id string, technique_name string")


def rule_scores(profiles: DataFrame, key: str, rules: list[tuple]) -> DataFrame:
    """Long ``(key, behaviour, score)``: weight of the satisfied over that of the applicable rules.

    Rules become one generated expression per profile, evaluated in the scan of the
    profile table; a null feature is not applicable. ``behaviour#attack`` profiles give
    their behaviour the best of their scores.
    """
    have = set(profiles.columns)
    names = list(dict.fromkeys(r[0] for r in rules))
    scored = []
    for name in names:
        hit = total = F.lit(0.0)
        for _, feature, op, lo, hi, weight in (r for r in rules if r[0] == name and r[1] in have):
            x = F.col(feature).cast("double")
            ok = x > lo if op == ">" else x < lo if op == "<" else x.between(lo, hi)
            hit = hit + F.when(ok, weight).otherwise(0.0)
            total = total + F.when(x.isNotNull(), weight).otherwise(0.0)
        scored.append(F.struct(F.lit(name.split("#")[0]).alias("behaviour"), F.when(total > 0, hit / total).otherwise(0.0).alias("score")))
    long = profiles.select(key, F.explode(F.array(*scored)).alias("s")).select(key, "s.*")
    return long.groupBy(key, "behaviour").agg(F.max("score").alias("score")) if len({n.split("#")[0] for n in names}) < len(names) else long


def expert_scores(profiles: DataFrame, key: str | list[str], table: dict = EXPERT_BOT_IOT, rivals: list[str] = BENIGN_RIVALS) -> DataFrame:
    """Long ``(*key, behaviour, score)`` of an additive scorer: sums, damping, a cap of 1, benign suppression.

    ``rivals`` are the scores that benign evidence must exceed to damp attacks; without any nothing is damped.
    """
    keys = [key] if isinstance(key, str) else key
    given = lambda v: F.expr(v) if isinstance(v, str) else F.lit(v)

    def raw(guard, steps, damp) -> Column:
        total = F.lit(0.0)
        for step in steps:
            branch = None
            for predicate, value in step:
                branch = F.when(F.expr(predicate), given(value)) if branch is None else branch.when(F.expr(predicate), given(value))
            total = total + branch.otherwise(0.0)
        for predicate, factor in damp or []:
            total = total * F.when(F.expr(predicate), factor).otherwise(1.0)
        return F.when(F.expr(guard), F.least(total, F.lit(1.0))).otherwise(0.0)

    wide = profiles.select(*keys, *(["min_ttl"] if rivals else []), *[raw(*spec).alias(f"_{b}") for b, spec in table.items()])
    benign = F.col("_normal_activity")
    dominated = (F.col("min_ttl") < 20) & (benign > 0.5) if rivals else F.lit(False)
    for b in rivals:
        dominated &= benign > F.col(f"_{b}")
    final = [
        F.struct(F.lit(b).alias("behaviour"), (F.col(f"_{b}") * F.when(dominated, F.lit(BENIGN_DAMPING.get(b, 1.0))).otherwise(1.0)).alias("score"))
        for b in table
    ]
    return wide.select(*keys, F.explode(F.array(*final)).alias("s")).select(*keys, "s.*")


def scaled_tactics(behaviours: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """``(*keys, tactic, p)``: weighted sums of behaviour scores over the largest of them, in four decimals."""
    mapped = behaviours.join(F.broadcast(table), "behaviour")  # a fixed table of some twenty rows
    sums = mapped.groupBy(*keys, "tactic").agg(F.sum(F.col("score") * F.col("weight")).alias("_s"))
    most = F.max("_s").over(Window.partitionBy(*keys))
    return sums.select(*keys, "tactic", F.when(most > 0, F.round(F.col("_s") / most, 4)).otherwise(F.col("_s")).alias("p"))


def sharpen(scores: DataFrame, key: str, power: float = 2.0) -> DataFrame:
    """``(key, behaviour, p)``: scores to a power, normalised; without any evidence all mass is on normal activity."""
    over = Window.partitionBy(key)
    raised = scores.withColumn("_s", F.pow("score", F.lit(power)))
    total = F.sum("_s").over(over)
    return raised.withColumn("_t", total).select(
        key, "behaviour", F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).when(F.col("behaviour") == "normal_activity", 1.0).otherwise(0.0).alias("p")
    )


def to_tactics(behaviours: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``(key, tactic, p)`` over the tactics of the weight table, normalised."""
    mapped = behaviours.join(F.broadcast(table), "behaviour")  # a fixed table of some twenty rows
    sums = mapped.groupBy(key, "tactic").agg(F.sum(F.col("p") * F.col("weight")).alias("_s"))
    total = F.sum("_s").over(Window.partitionBy(key))
    return sums.select(key, "tactic", F.when(total > 0, F.col("_s") / total).otherwise(0.0).alias("p"))


def attack_tactics(df: DataFrame, table: DataFrame, label: str = "attack") -> DataFrame:
    """Adds tactic and technique columns; unknown attacks get ``Unknown``."""
    joined = df.join(F.broadcast(table.withColumnRenamed("attack", label)), label, "left")  # a fixed table
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in table.columns if c != "attack"})


def tactic_set(behaviours: DataFrame, keys: list[str], table: DataFrame, priority: list[str] = TACTICS) -> DataFrame:
    """Per key the set of tactics its behaviours name, and the first of them by priority."""
    rank = F.array_position(F.array(*[F.lit(t) for t in priority]), F.col("tactic"))
    named = behaviours.join(F.broadcast(table), "behaviour").withColumn("_r", F.when(rank > 0, rank).otherwise(len(priority) + 1))
    return named.groupBy(*keys).agg(F.array_sort(F.collect_set("tactic")).alias("tactics"), F.min(F.struct("_r", "tactic"))["tactic"].alias("primary_tactic"))


def benign_groups(profiles: DataFrame, least_rule: float = 0.5, least_other: float = 0.5, most_win: float = 0.5, most_fan: float = 30.0, least_size: int = 100) -> DataFrame:
    """Adds ``benign`` and ``reason``: by rule score, by TTL fingerprint, or by TTL 0 without a scan window."""
    by_rule = (F.col("benign_score") >= least_rule) & (F.col("benign_score") > F.col("attack_score")) & (F.col("size") > least_size)
    by_ttl = F.col("share_ttl_other") >= least_other
    by_zero = (F.col("share_ttl0") >= 0.5) & (F.col("share_win1024") < most_win) & (F.col("share_syn") < 0.5) & (F.col("fan_out") < most_fan)
    reason = F.when(by_rule, "rule").when(by_ttl, "ttl").when(by_zero, "window")
    return profiles.withColumn("reason", reason).withColumn("benign", reason.isNotNull())


def default_labels(profiles: DataFrame) -> DataFrame:
    """Adds ``label`` and ``confidence``: a decision tree over a profile, used where no other label is given."""
    c = F.col
    low, mid = c("min_ttl") < 25, c("min_ttl") <= 50
    scan = (c("pps") > 5000) & (c("n_dst") > 5)
    tree = [
        (c("tcp_flags") < 4, [(c("dir_ratio") > 100, "syn_flooding", 0.9), ((c("n_dst") <= 5) & (c("n_src") <= 3), "connection_attempts", 0.8), (F.lit(True), "syn_flooding", 0.8)]),
        (c("out_bytes") > 200000, [(F.lit(True), "data_transfer", 0.9)]),
        (c("out_bytes") > 10000, [(c("min_ttl") < 30, "normal_browsing", 0.8), (c("fan_out") > 30, "data_transfer", 0.8), (F.lit(True), "normal_browsing", 0.7)]),
        (low, [(F.lit(True), "normal_browsing", 0.75)]),
        (~mid, [(c("dir_ratio") > 100, "volumetric_flooding", 0.75), (F.lit(True), "service_probing", 0.65)]),
        (F.lit(True), [(scan, "port_scanning", 0.8), (F.lit(True), "service_probing", 0.7)]),
    ]
    found = None
    for outer, leaves in tree:
        for inner, label, confidence in leaves:
            value = F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
            found = F.when(outer & inner, value) if found is None else found.when(outer & inner, value)
    out = profiles.withColumn("_l", found)
    browsing = lambda p: F.struct(F.lit("normal_browsing").alias("label"), F.lit(p).alias("confidence"))
    large = (c("proportion") > 0.05) & (c("tcp_flags") > 8) & (c("_l.label") != "normal_browsing")
    out = out.withColumn("_l", F.when(large, browsing(0.85)).otherwise(c("_l")))
    out = out.withColumn("_l", F.when((c("_l.label") == "data_transfer") & (c("min_ttl") < 25), browsing(0.8)).otherwise(c("_l")))
    return out.select(*profiles.columns, "_l.label", "_l.confidence")
