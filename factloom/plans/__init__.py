"""Plan helpers shared by the operators: session settings and scratch tables."""
