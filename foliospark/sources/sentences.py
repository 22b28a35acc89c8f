"""The corpus of the synthetic lines."""

#: The sentences that synthetic lines are drawn from.
SENTENCES = [
    "The drain current increases with gate voltage.",
    "The threshold voltage is approximately 0.7 V.",
    "Semiconductor devices depend on carrier concentration.",
    "VGS = VTH + VOV in the saturation region.",
    "The small-signal transconductance gm is proportional to ID.",
    "MOSFET operation in deep subthreshold exhibits exponential current.",
    "The frequency response is limited by parasitic capacitances Cgs and Cgd.",
    "Bandgap energy Eg for Silicon is 1.12 eV at room temperature.",
    "Intrinsic carrier concentration ni is temperature dependent.",
    "Doping with acceptor atoms creates p-type semiconductor material.",
    "The pn junction depletion width depends on reverse bias voltage VR.",
    "KVL states the sum of voltages in a closed loop equals zero.",
    "KCL states the sum of currents entering a node equals zero.",
    "The differential equation describes RLC transient response.",
    "Input impedance Zin looking into the gate is capacitive at low frequencies.",
    "Output resistance ro represents the channel-length modulation parameter lambda.",
    "The gain-bandwidth product of the operational amplifier is constant.",
    "Feedback improves circuit linearity and gain stability.",
    "Common-source amplifier provides moderate voltage gain with 180 degree phase shift.",
    "The Miller effect multiplies feedback capacitance Cgd by 1 + Av.",
    "Carrier mobility mu is higher for electrons than holes.",
    "Poisson's equation relates electrostatic potential to charge density rho.",
    "Diffusion current is driven by spatial concentration gradient dn/dx.",
    "Drift current velocity is given by v = mu * E for low electric fields.",
    "Thermal voltage VT = k * T / q equals approximately 25.9 mV at 300 K.",
    "CMOS inverter dynamic power dissipation is P = C * VDD^2 * f.",
    "Static power dissipation arises from subthreshold leakage currents.",
    "The noise margin NMH and NML ensure reliable digital operation.",
    "S-parameters characterize high-frequency microwave two-port networks.",
    "Fourier transform converts time-domain signals to frequency spectra.",
    "Laplace transform simplifies differential circuit equations into s-domain.",
    "Bode plots illustrate magnitude in dB and phase in degrees versus frequency.",
    "The transfer function H(s) contains poles and zeros in the complex plane.",
    "Unity-gain frequency wt corresponds to the transition frequency of the transistor.",
    "The slew rate SR limits the maximum rate of change of the output voltage.",
    "Common-mode rejection ratio CMRR measures rejection of input common signals.",
    "Phase margin PM greater than 45 degrees ensures closed-loop stability.",
    "Quasi-Fermi levels describe carrier populations under non-equilibrium.",
    "Ohm's law relates voltage, current, and resistance: V = I * R.",
    "Capacitive reactance Xc = 1 / (2 * pi * f * C) decreases with frequency.",
    "Inductive reactance XL = 2 * pi * f * L increases with frequency.",
    "Maximum power transfer theorem occurs when Zload equals Zsource conjugate.",
    "The quality factor Q quantifies resonant circuit selectivity and energy loss.",
    "Decoupling capacitors suppress high-frequency supply voltage noise spikes.",
    "Differential signaling provides high immunity to substrate and supply noise.",
    "Bandpass filter passes frequencies within lower and upper cutoff limits.",
    "Schottky diode exhibits lower forward voltage drop and faster switching.",
    "Zener diode maintains constant breakdown voltage in reverse bias regime.",
    "Avalanche breakdown occurs via impact ionization in high electric fields.",
    "Silicon dioxide SiO2 acts as an excellent gate dielectric insulator.",
]
