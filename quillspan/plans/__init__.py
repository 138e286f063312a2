"""Register views: queries composed of operators over the register tables."""
