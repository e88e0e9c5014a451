"""Operators for training data: one module per problem, with its queries; ``registry`` names them."""
