"""Fixed values that results depend on."""

# ---- fixed values: threshold ladders --------------------------------------------------
RUNGS_LOADER = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512]
RUNGS_SCORING = [1, 2, 4, 8, 16, 32, 64, 128, 256]
TARGET_FIDELITY = 0.75

# ---- fixed values: gate name sets -----------------------------------------------------
TWO_QUBIT = ["cx", "cz", "cp", "rzz", "rxx", "ryy", "swap", "cu1", "cu3", "cu",
             "cry", "crx", "crz", "ch", "cy", "csx"]
THREE_QUBIT = ["ccx", "rccx", "cswap", "ccz"]
PARAMETERIZED = ["rx", "ry", "rz", "p", "cp", "rzz", "rxx", "ryy",
                 "u", "u1", "u2", "u3", "cu1", "cu3", "cry", "crx", "crz"]
ENTANGLING = TWO_QUBIT + THREE_QUBIT
COUNTED = ["cx", "cz", "cp", "rzz", "rxx", "swap", "ccx", "rccx", "cswap",
           "h", "x", "y", "z", "rx", "ry", "rz", "p",
           "u", "u1", "u2", "u3",
           "s", "sdg", "t", "tdg", "sx", "sxdg",
           "cu", "cu1", "cu3", "cry", "crx", "crz", "ch"]
CLIFFORD = ["h", "x", "y", "z", "s", "sdg", "sx", "sxdg", "cx", "cz", "swap", "iswap"]
NON_CLIFFORD = ["t", "tdg", "p", "rx", "ry", "rz", "u", "u1", "u2", "u3",
                "cp", "rzz", "rxx", "cu", "cu1", "cu3", "crx", "cry", "crz", "ch"]

# ---- fixed values: family rules in priority order -------------------------------------
# (family, required, any of, forbidden, max gate types, check)
FAMILY_RULES = [
    ("Shor", ("cp", "cx", "h"), ("cswap",), (), None, "qregs>=3"),
    ("Pricing_Call", ("cx", "ry"), ("ccx", "cry"), (), None, None),
    ("GraphState", ("cz", "h"), (), ("cx", "cp", "ry", "rx", "rzz"), 2, None),
    ("W_State", ("ry", "cz", "cx"), (), ("cp", "rzz", "u2", "h"), None, None),
    ("Ground_State", ("cz", "u2"), (), ("cx", "cp", "rzz", "ry", "ccx"), None, None),
    ("Portfolio_VQE", ("ry", "cz"), (), ("cx", "cp", "rzz", "u2", "u3", "ccx"), None, None),
    ("QAOA", ("rzz", "rx", "h"), (), ("cx", "cz", "cp", "ry", "ccx"), None, None),
    ("Portfolio_QAOA", ("rzz", "rx"), ("u2", "u3"), ("cx", "cz", "cp", "ccx"), None, None),
    ("Grover_V_Chain", ("cx", "cp"), ("rccx", "ccx"), (), None, "qregs>=2"),
    ("Grover_NoAncilla", ("cx", "cp"), ("cu", "cu1"), ("rzz", "cz", "ry", "cswap", "swap", "rccx"), None, None),
    ("QNN", ("cx", "p"), ("u2", "ry"), ("cz", "cp", "rzz", "ccx"), None, None),
    ("TwoLocalRandom", ("ry", "cx"), (), ("cz", "cp", "rzz", "u2", "u3", "ccx", "p"), None, "all_to_all"),
    ("VQE", ("ry", "cx"), (), ("cz", "cp", "rzz", "u2", "u3", "ccx", "p"), None, "nearest_neighbor"),
    ("QPE_Exact", ("cp", "h", "x"), ("swap",), ("rzz", "ccx", "ry", "cx", "cswap", "cu"), None, "qregs>=2"),
    ("QFT_Entangled", ("cp", "h", "cx"), ("swap",), ("rzz", "ccx", "cswap", "ry", "x"), None, None),
    ("QFT", ("cp", "h"), ("swap",), ("cx", "rzz", "ccx", "cswap", "x"), None, None),
    ("Amplitude_Estimation", ("cp", "cx"), ("u", "u3", "u2"), (), None, "qregs>=2"),
    ("Deutsch_Jozsa", ("cx",), ("u2", "h"), (), None, "star"),
    ("CutBell", ("cx", "h"), (), ("cz", "cp", "ry", "rz", "rx", "rzz", "u2", "u3"), 2, "long_range_only"),
    ("GHZ", ("cx", "h"), (), ("cz", "cp", "ry", "rz", "rx", "rzz", "u2", "u3"), 2, "nearest_neighbor"),
]

# ---- fixed values: smallest rung allowed per family -----------------------------------
FAMILY_FLOOR = {
    "TwoLocalRandom": 64, "QNN": 16, "Portfolio_QAOA": 8, "Portfolio_VQE": 8,
    "Pricing_Call": 4, "Ground_State": 4, "Amplitude_Estimation": 4, "GraphState": 2, "Shor": 2,
    "CutBell": 2, "QFT_Entangled": 2, "VQE": 2, "W_State": 2, "GHZ": 2,
    "Grover_V_Chain": 1, "Grover_NoAncilla": 1, "QAOA": 1, "QFT": 1, "QPE_Exact": 1,
    "Deutsch_Jozsa": 1,
    "Unknown": 4,
}
HARD_FAMILIES = ["TwoLocalRandom", "QNN", "Portfolio_QAOA", "Portfolio_VQE", "Pricing_Call",
                 "Ground_State", "Amplitude_Estimation", "Shor", "GraphState"]

# ---- fixed values: names that mark a column as label or metadata ----------------------
NOT_A_FEATURE = [
    "file", "backend", "precision", "family", "predicted_family", "true_family",
    "selected_threshold", "selected_fidelity", "selected_threshold_log2",
    "forward_wall_s", "forward_threshold", "forward_unique_outcomes", "forward_peak_rss_mb",
    "estimated_per_shot_s", "estimated_setup_s",
    "state_setup_wall_s", "state_setup_peak_rss_mb",
    "log_forward_wall_s", "log_setup_s", "log_per_shot_s",
    "is_gpu", "is_double", "verify_p_return_zero",
    "sweep_min_fidelity", "sweep_max_fidelity", "n_sweep_rungs",
    "fidelity_at_1", "rungs_to_099", "biggest_fid_jump", "biggest_jump_rung",
    "sweep_fid_", "sweep_wall_", "sweep_rss_",
]

# ---- fixed values: recommended held-out circuits --------------------------------------
RECOMMENDED_TEST = [
    "ae_indep_qiskit_130.qasm", "dj_indep_qiskit_30.qasm", "ghz_indep_qiskit_30.qasm",
    "ghz_indep_qiskit_130.qasm", "grover-noancilla_indep_qiskit_11.qasm",
    "grover-v-chain_indep_qiskit_17.qasm", "portfolioqaoa_indep_qiskit_17.qasm",
    "portfoliovqe_indep_qiskit_18.qasm", "qft_indep_qiskit_15.qasm",
    "qftentangled_indep_qiskit_30.qasm", "qpeexact_indep_qiskit_30.qasm",
    "wstate_indep_qiskit_130.qasm",
]
